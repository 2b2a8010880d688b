"""Conversations, archives and the pipeline."""

import gzip
import random

import duckdb
import pytest

from contigua.llm import chat, decontam, line_dedup, near_dups, queries, rules, warc

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, duck, name):
    found = queries.queries()[name](spark, DATA)
    assert rows_of(found) == sorted(duck.sql(queries.oracle_sql()[name]).select(*found.columns).fetchall(), key=str)


def conversations(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "e") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, place string").repartition(3)


def test_snapshots_collapse(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", None)]
    rows = [(c, i, *t) for c, n in ((1, 1), (2, 2), (3, 4), (4, 4), (5, 3)) for i, t in enumerate(a[:n])]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (7, None, None, ""), (None, 0, "user", "lost"), (6, 1, "assistant", "other"), (8, 5, "user", "<|im_end|>")]
    found = {r["conv_id"]: r for r in chat.formatted(conversations(spark, rows)).collect()}
    assert set(found) == {3, 6, 7, 8}
    assert (found[3]["n_turns"], found[3]["n_copies"]) == (4, 2)
    assert found[3]["text"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert found[6]["n_turns"] == 2 and found[7]["text"] == "<|im_start|>unknown\n<|im_end|>\n"
    assert found[8]["text"] == "<|im_start|>user\n< |im_end|><|im_end|>\n"
    assert chat.formatted(conversations(spark, [])).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d") for i, u, h in rows], "page_id long, url string, html string, digest string").repartition(3)


def test_archives(spark, tmp_path):
    big, other = "é" * 700, "x" * 1000
    rows = [(1, "u1", big), (2, "u2", big), (3, "u\r\n3", big), (4, None, "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "v", other), (9, "w", other[1:]), (None, "n", big), (3, "u", big)]
    path = f"file://{tmp_path}/a"
    warc.written_archives(pages(spark, rows), path)
    found = warc.read_archives(spark, path)
    got = sorted(((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found.collect()), key=str)
    urn = "urn:page:"
    assert got == sorted(
        [(urn + "1", "revisit", urn + "3", 1400), (urn + "2", "revisit", urn + "3", 1400), (urn + "3", "response", None, 1400), (urn + "3", "response", None, 1400), (urn + "4", "response", None, 5), (urn + "5", "response", None, 5), (urn + "6", "response", None, 0), (urn + "7", "response", None, 0), (urn + "8", "response", None, 1000), (urn + "9", "response", None, 999), (urn, "response", None, 1400)],
        key=str,
    )
    for r in found.where("record_type = 'response'").collect():
        assert len(r["payload"]) == r["payload_bytes"] and warc.sha1_hex(bytes(r["payload"])) == r["payload_digest"]
    one = found.where("record_id = 'urn:page:2'")
    assert [r["payload_digest"] for r in one.collect()] == [warc.sha1_hex(big.encode())]
    assert "Filter " not in one._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert warc.read_archives(spark, path, payload=False).where("payload is not null").isEmpty()
    # appended archives add up
    warc.written_archives(pages(spark, rows[:5]), path)
    assert warc.read_archives(spark, path).count() == len(rows) + 5
    # the same archives without a manifest, one of them unpacked
    for m in (tmp_path / "a").glob(warc.MANIFEST + "*"):
        m.unlink()
    files = sorted((tmp_path / "a").glob("*.warc.gz"))
    (tmp_path / "a" / "z.warc").write_bytes(gzip.decompress(files[0].read_bytes()))
    files[0].unlink()
    assert warc.read_archives(spark, path).count() == len(rows) + 5
    again = warc.read_archives(spark, path).where("record_type = 'revisit'")
    assert again.count() == 4
    (tmp_path / "a" / "z.warc").write_bytes((tmp_path / "a" / "z.warc").read_bytes()[:-300])
    for payload in (True, False):
        with pytest.raises(Exception, match="archive ends"):
            warc.read_archives(spark, path, payload).collect()


def test_archives_are_cut_and_payloads_passed_over(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/b"
    rng = random.Random(1)
    rows = [(i, "u", "".join(rng.choices("abcdefghijklmnop<> ", k=40_000)) + str(i // 2)) for i in range(400)]
    warc.written_archives(pages(spark, rows).coalesce(1), path, cut=1 << 20)
    found = warc.read_archives(spark, path)
    assert found.rdd.getNumPartitions() > 2
    assert sorted(bytes(r["payload"]).decode() for r in found.collect()) == sorted(r[2] for r in rows)
    # the reader itself inflates no more than the headers when no payload is wanted
    inflated = []
    more = warc.Stream.more
    monkeypatch.setattr(warc.Stream, "more", lambda self, *a: inflated.append(len(self.held)) or more(self, *a))
    reader = warc.WarcReader(path, False)
    rows_read = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows_read) == 400 and all(r["payload"] is None and r["payload_bytes"] > 40_000 for r in rows_read)
    assert len(inflated) == 400  # one step of HEAD bytes for each record
    # an archive that lost its end fails whether payloads are wanted or not
    file = max((tmp_path / "b").glob("*.warc.gz"), key=lambda f: f.stat().st_size)
    file.write_bytes(file.read_bytes()[:-10])
    for payload in (True, False):
        with pytest.raises(Exception, match="archive ends"):
            warc.read_archives(spark, path, payload).collect()


def test_no_pages(spark, tmp_path):
    warc.written_archives(pages(spark, []), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, bench = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "bpe"]
    now = stages["quality_rules"](spark, docs, DATA)
    assert rows_of(now) == rows_of(rules.kept_only(docs, rules.learned(docs, labels)))
    lines = stages["line_dedup"](spark, now, DATA)
    assert lines.columns == docs.columns and lines.count() == now.count()
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(now).collect()}
    near = stages["near_dedup"](spark, lines, DATA)
    assert near.columns == docs.columns and 0 < near.count() < lines.count()
    clean = stages["decontamination"](spark, near, DATA)
    gone = {r["doc_id"] for r in decontam.found(near, bench).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in near.collect()} - gone
    last = stages["bpe"](spark, clean, DATA)
    assert rows_of(last) == rows_of(corpus_pipeline.run(spark, DATA))
    assert near_dups.one_of_each(docs.limit(0)).count() == 0
