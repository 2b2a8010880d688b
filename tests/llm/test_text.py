"""Rules, classifier, tokenizer, decontamination and extraction: models, round trips and defined cases."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contigua.llm import bpe, crf, decontam, html_text, queries, rules

DATA = "/root/testdata/sf0.01"
BPE = queries.VOCABULARY
WORD = re.compile(r"[^\x20\x09-\x0D]+")
simhash_lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def statistics(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered, seen, dups = set(), set(), 0
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in rules.SYMBOLS for c in text or ""), dups, len(covered)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "1", 2, "k") for i, t in rows], "doc_id long, text string, n_words string, key int, _text string").repartition(3)


def test_base_statistics(spark):
    rng = random.Random(1)
    texts = [None, "", "  \n\t", "a b c d e f g h a b c d e f g h", "x " * 500, "\x1c\x85  é", "a\n\na\na\n"]
    texts += [" ".join(rng.choice("abc") for _ in range(n)) for n in range(7, 60)]
    found = rules.judged(documents(spark, list(enumerate(texts)) + [(0, None)]), [])
    assert {"key", "_text", "doc_id", "text"} <= set(found.columns)
    for r in found.collect():
        n, *rest = statistics(r["text"])
        assert (r["n_words"], *(r[c] for c in rules.BASE[1:])) == (n, *rest)
        assert r["base_failed"] == (n < 20 or 100 * rest[-1] > 30 * n)
        assert r["kept"] == (not r["base_failed"])
    assert rules.judged(documents(spark, []), []).count() == 0


def test_learned_rules(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    learned = rules.learned(docs, labels)
    assert learned
    judged = rules.judged(docs, learned).join(labels, "doc_id").where("not base_failed and crc32(cast(doc_id as string)) % 5 = 0").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in judged]) > 0.95
    kept = rules.kept_only(docs, learned)
    assert kept.columns == docs.columns
    assert kept.count() == rules.judged(docs, learned).where("kept").count()
    assert rules.learned(docs, labels.where("quality = 1")) == []
    assert rules.learned(docs, labels.limit(0)) == []


def test_rules_of_known_rows():
    rows = [(int(i % 2), {s: 0.0 for s in rules.RATIOS} | {"symbols_per_word": 0.9 * (1 - i % 2), "chars_per_word": float(i % 7)}) for i in range(90)]
    (rule,) = rules.learn(rows)
    assert [(c.stat, c.above) for c in rule] == [("symbols_per_word", True)]
    assert rules.learn([]) == []


def test_field_matches_enumeration():
    e, m = np.array([1.0, -2, 0.5, 3]), np.array([[0.5, -0.2], [0.1, 0.7]])
    p, pairs = crf.marginals(e, m)
    z, one, two = 0.0, np.zeros(4), np.zeros((2, 2))
    for c in itertools.product([0, 1], repeat=4):
        w = np.exp(sum(x * y for x, y in zip(e, c, strict=True)) + sum(m[c[i], c[i + 1]] for i in range(3)))
        z, one = z + w, one + w * np.array(c)
        for i in range(3):
            two[c[i], c[i + 1]] += w
    assert np.allclose(p, one / z) and np.allclose(pairs, two / z)
    together, joint = crf._all_marginals(np.r_[e, e[:2]], m, [np.array([0, 4]), np.array([1, 5]), np.array([2]), np.array([3])], np.array([4, 2]))
    assert np.allclose(together[:4], p) and np.allclose(together[4:], crf.marginals(e[:2], m)[0])
    assert np.allclose(joint, pairs / 4 + crf.marginals(e[:2], m)[1] / 2)


def test_classifier(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    found = queries.op5_quality_crf(spark, DATA).join(labels, "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    field = crf.fit(crf.sample(docs, labels, most=100))
    odd = documents(spark, [(None, None), (1, ""), (1, ""), (2, "\n" * 5000), (3, "word " * 200_000)])
    rows = crf.scored(odd, field).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert crf.scored(documents(spark, []), field).count() == 0
    assert crf.score(crf.fit([]), b"x") == 0.5
    assert crf.score(crf.fit([(1, b"x")]), b"y") > 0.99


def test_repeated_doc_ids_teach_once(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    again = docs.unionAll(docs).unionAll(docs.withColumn("text", F.lit("x " * 50))).unionAll(docs.withColumn("text", F.lit(None).cast("string")))
    n = labels.where("quality in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0").join(docs, "doc_id").select("doc_id").distinct().count()
    assert len(crf.sample(docs, labels)) == len(crf.sample(again, labels)) == rules.labelled_sample(again, labels).count() == min(n, rules.SAMPLE)
    assert sorted(crf.sample(docs, labels)) == sorted(crf.sample(docs.unionAll(docs), labels))
    assert rules.learned(docs, labels) == rules.learned(docs.unionAll(docs), labels)
    few = crf.sample(docs, labels, most_bytes=20_000)
    assert 0 < len(few) < n and sum(len(t) for _, t in few) <= 20_000
    assert crf.sample(docs.limit(0), labels) == []


def test_bpe_matches_the_library(spark):
    library, own = Tokenizer.from_file(BPE), bpe.ByteBpe(BPE)
    texts = ["", "a<|endoftext|> b  \n", "<|endoftext|><|endoftext|>", "  x y " + "z" * 1000, "I'll 'S é\x00 🙂 don't", "a\r\n\n  b", "　\x85 1234567", "x" * 30_000]
    texts += [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(200).collect()]
    for t in texts:
        ids = own.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == t
    rng = random.Random(0)
    for _ in range(100):
        ids = [rng.randrange(50257) for _ in range(30)]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_columns(spark):
    df = documents(spark, [(None, None), (1, ""), (2, "to be"), (2, "to be")])
    rows = bpe.decode(bpe.encode(df, BPE), BPE).collect()
    assert sorted(r["decoded"] for r in rows) == ["", "", "to be", "to be"]
    found = bpe.encode_digests(df, BPE, with_ids=True).collect()
    ids = bpe.ByteBpe(BPE).encode("to be")
    assert [(r["n_tokens"], r["ids_sha256"], r["ids"]) for r in found if r["doc_id"] == 2] == [(len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), ids)] * 2
    assert bpe.encode_digests(documents(spark, []), BPE).count() == 0


def test_bpe_skips_stale_entries(tmp_path):
    letters = bpe.byte_letters()
    vocab = {letters[b]: b for b in range(256)} | {"ab": 256, "bc": 257, "abc": 258}
    (tmp_path / "t.json").write_text(json.dumps({"added_tokens": [], "model": {"vocab": vocab, "merges": ["b c", "a b", "a bc"]}}))
    own = bpe.ByteBpe(str(tmp_path / "t.json"))
    assert own.encode("abc") == [258] and own.encode("ab") == [256] and own.encode("aab") == [97, 256]


def edit_distance_within(piece, text):
    """Fewest edits between the piece and any part of the text."""
    text = np.frombuffer(text, np.uint8)
    place = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(piece, 1):
        new = np.r_[i, np.minimum(row[:-1] + (text != c), row[1:] + 1)]
        row = np.minimum.accumulate(new - place) + place
    return row.min()


def index_of(items):
    return decontam.index_of([(i, piece, v) for i, t in items for piece, v in decontam.pieces_of(t.encode())])


def test_decontamination_matches_brute_force():
    rng = random.Random(2)
    alphabet = "abcdefgh "
    items = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (30, 60, 100, 170)]
    index = index_of(enumerate(items))
    assert len(index.pieces) > len(items)
    for _ in range(60):
        item = rng.randrange(len(items))
        s = list(" ".join(items[item].split()))
        for _ in range(rng.randrange(0, max(2, len(s) // 7))):
            j, z = rng.randrange(len(s)), rng.random()
            s[j : j + 1] = [] if z < 0.3 else [rng.choice("xyz")] if z < 0.7 else [s[j], "q"]
        text = "".join(rng.choice("mnop ") for _ in range(50)) + "".join(s).upper() + "".join(rng.choice("mnop ") for _ in range(50))
        found = {(i, e) for _, i, _, _, e in decontam._search(index, [text.encode()])}
        plain = decontam.normalised(text.encode())[0].tobytes()
        expected = {}
        for (i, p), k in zip(index.pieces, index.edits, strict=True):
            e = edit_distance_within(p.tobytes(), plain)
            if e <= k:
                expected[i] = min(e, expected.get(i, 99))
        best = {}
        for i, e in found:
            best[i] = min(e, best.get(i, 99))
        assert best == expected


def test_regions_count_once_wherever_parts_end(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(400)]
    item = " ".join(rng.choices(words, k=40))
    wide = item.replace(" ", " " * 700)
    index = index_of([(1, item)])
    filler = lambda n: " ".join(rng.choices(words, k=n))
    for text in (f"{filler(90)} {item} {filler(300)} {item}", f"{wide} {filler(60)}\n\n{wide}  ", item, f"{filler(700)}\t{item[:150]}"):
        whole = sorted(decontam._search(index, [text.encode()]))
        assert whole
        for size in (500, 1000, 4096):
            monkeypatch.setattr(decontam, "PART", size)
            assert sorted(decontam._search(index, [text.encode()])) == whole
        monkeypatch.undo()


def test_decontamination_cases(spark):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog near the river bank"), (1, None), (2, None), (3, ""), (None, "y" * 90), (4, "short"), (5, "z" * 40)], "item_id long, text string")
    hit = "well: the QUICK  brown\nfox jumps over the lazy dog near the river bank!"
    docs = documents(spark, [(10, hit), (10, hit), (11, None), (12, ""), (13, "nothing to see here at all, move on please"), (None, hit), (14, "z" * 100), (15, "w " * 3_000_000 + hit)])
    found = {(r["doc_id"], r["item_id"]): r for r in decontam.found(docs, bench).collect()}
    assert set(found) == {(10, 1), (None, 1), (14, 5), (15, 1)}
    assert found[10, 1]["edits"] == 0 and found[15, 1]["begin"] >= 6_000_000
    assert sorted(r["doc_id"] for r in decontam.clean(docs, bench).where("doc_id is not null").collect()) == [11, 12, 13]
    assert decontam.found(docs, bench.limit(0)).count() == 0
    assert decontam.found(documents(spark, []), bench).count() == 0


def test_blocks_of_the_benchmark_give_the_same_matches(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontam.found(docs, bench).collect()))
    cut = decontam.pieces(bench)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 40_000)
    sizes = [sum(len(x) for _, x, _ in block) for block in decontam.blocks(cut)]
    assert 2 <= len(sizes) and max(sizes) < 80_000
    assert whole and sorted(map(tuple, decontam.found(docs, bench).collect())) == whole


def test_scores_in_parts_are_those_of_whole_texts(monkeypatch):
    rng = random.Random(6)
    rows = [(i % 2, "\n".join(" ".join(rng.choice(("Good", "words", "||", "x1", "$$ &&"[: 1 + 4 * (i % 2)])) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 30))).encode()) for i in range(60)]
    field = crf.fit(rows)
    texts = [t for _, t in rows] + [b"", b"\n", b"\n" * 50, b"a\n" * 40 + b"last", b"one long line " * 50]
    whole = []
    for t in texts:
        x, size = crf.line_shapes(t)
        p, _ = crf.marginals(crf.with_neighbours(x) @ field.weights, field.moves)
        mean = np.clip(p @ (size + 1.0) / (size + 1.0).sum(), 1e-6, 1 - 1e-6)
        whole.append(np.log(mean / (1 - mean)))
    for lines, size in ((4096, 1 << 18), (3, 1 << 18), (1, 1 << 18), (4096, 5)):
        monkeypatch.setattr(crf, "PART_LINES", lines)
        monkeypatch.setattr(crf, "PART_BYTES", size)
        assert all(b"\n".join(crf.line_parts(t)) == t for t in texts)
        assert np.allclose([crf.good_share(field, t) for t in texts], whole, atol=1e-9)


def test_many_lines_are_scored_in_bounded_memory():
    import tracemalloc

    field = crf.Field(np.ones(crf.FEATURES) / 10, np.ones((2, 2)))
    tracemalloc.start()
    assert 0 <= crf.score(field, b"\n" * 100_000) <= 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_rules_of_one_or_two_characters_match_brute_force(monkeypatch, limit):
    monkeypatch.setattr(decontam, "LIMIT", limit)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 6)))
    items = [(1, "-" * 120), (2, "-" * 60), (3, "=-" * 40), (4, word() + " " + "-" * 50 + " " + word()), (5, " ".join([word(), "--"] * 9)), (6, "-" * 60)]
    index = index_of(items)
    same = {p.tobytes(): [i for i, t in items if p.tobytes() in [x for x, _ in decontam.pieces_of(t.encode())]] for _, p in index.pieces}
    for text in ("-" * 400, "-" * 55, "=-" * 70 + "x" + "-" * 64, items[3][1] + " y " + items[4][1], ("ab " + "-" * 40 + "\n") * 5, "-" * 90 + "z" + "-" * 30):
        plain = decontam.normalised(text.encode())[0].tobytes()
        expected = {}
        for (_, p), k, v in zip(index.pieces, index.edits, index.exact, strict=True):
            e = (0 if p.tobytes() in plain else 99) if v else edit_distance_within(p.tobytes(), plain)
            if e <= k:
                for i in same[p.tobytes()]:
                    expected[i] = min(e, expected.get(i, 99))
        best = {}
        for _, i, begin, end, e in decontam._search(index, [text.encode()]):
            assert 0 <= begin < end <= len(text)
            best[i] = min(e, best.get(i, 99))
        assert best == expected, text


def test_long_rules_are_searched_in_bounded_memory():
    import tracemalloc

    index = index_of([(i, "-" * (30 + i)) for i in range(100)] + [(100 + i, f"{i} some words {'-' * 50} and more of them {i}") for i in range(10)])
    tracemalloc.start()
    found = list(decontam._search(index, [b"-" * 200_000]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {i for _, i, *_ in found} == set(range(100)) and peak < 300 << 20


def test_decontamination_finds_thirteen_words_at_any_offset():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(60)]
    index = index_of([(7, " ".join(words))])
    for i in range(len(words) - 12):
        text = "before it " + " ".join(words[i : i + 13]) + " after it"
        assert {item for _, item, *_ in decontam._search(index, [text.encode()])} == {7}
    assert not list(decontam._search(index, [" ".join(words[20:29]).encode()]))


def test_decontamination_query(spark):
    small = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]): r for r in queries.op9_decontamination(spark, small).collect()}
    cut = [(i, p, 0 if v else decontam.budget(len(p)), {p[j : j + 8] for j in range(len(p) - 7)}) for i, t in items.items() for p, v in decontam.pieces_of(t.encode())]
    expected = {}
    for d, t in docs.items():
        plain = re.sub(rb"[ \t\n\x0b\x0c\r\x00]+", b" ", t.encode()).translate(simhash_lower)
        there = {plain[j : j + 8] for j in range(len(plain) - 7)}
        for i, p, k, of_piece in cut:
            # within its edits a piece shares an 8-gram at least
            if len(of_piece & there) and (e := 0 if p in plain else edit_distance_within(p, plain) if k else 99) <= k:
                expected[d, i] = min(e, expected.get((d, i), 99))
    assert expected and {k: r["edits"] for k, r in found.items()} == expected
    for (d, _), r in found.items():
        assert 0 <= r["begin"] < r["end"] <= len(docs[d].encode()) and r["n_regions"] > 0


PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><div class="cookie-notice">We use cookies on this site to make it work well for all</div>
<!-- <p>no</p> --><article><header><h1>A &amp; B</h1></header><p>First   paragraph with <b>bold</b> and <a href="x">a link</a> in a text.<br>More&nbsp;of it &lt;here&gt;.<p>Yes.
<form><label>Name</label><input name=q><button>Send</button></form><div class='ad'>Buy now, it is cheap and good and new</div><p title="a > b">Last words of the article, which are a few more.</p></article>
<aside>Related things that nobody asked for at all</aside><section id="comments"><h2>Comments</h2><p>I liked this article so much that I wrote a long comment about it.</p></section>
<footer>&copy; Somebody</footer></body></html>"""


def test_extraction():
    assert html_text.main_text(PAGE) == "A & B First paragraph with bold and a link in a text. More of it <here>. Yes. Last words of the article, which are a few more."
    plain = "<body><ul><li><a href=a>Home</a><li><a href=b>News</a></ul><h1>Title of it</h1><p>" + "some words here " * 15 + "</p><p>" + "other words " * 20 + "</p><ul><li><a href=c>x</a></ul>"
    assert html_text.main_text(plain) == "Title of it " + ("some words here " * 15 + "other words " * 20).strip()
    assert [html_text.main_text(x) for x in (None, "", "<p>", "<!-- ", "<script>x", "<a href='")] == [""] * 6
    assert html_text.main_text("<article>a < b &amp;amp; c &am") == "a < b &amp; c &am"
    assert html_text.main_text("<article>" + "word " * 100_000).count("word") == 100_000


def test_self_closed_elements_are_empty():
    text = "words of the article that are many enough to be its main text and go on"
    for tag in ('<svg class="i"/>', "<SVG />", '<iframe src="x"/>', "<object/>", "<canvas />"):
        assert html_text.main_text(f"<article><p>{text}</p>{tag}<p>{text}</p></article>") == f"{text} {text}"
    assert html_text.main_text(f"<article><svg/><p>{text}</p><svg><text>no</text></svg></article>") == text
    assert html_text.main_text(f"<article><p>{text}</p><iframe src=x/>no</iframe></article>") == text


PARAGRAPH = "many words of a real paragraph that goes on and on about the topic of this page and some more"


def test_names_are_one_feature_of_many():
    p = PARAGRAPH
    assert html_text.FEATURES[html_text.TREE[0]] != "named"
    for name in ("layout no-sidebar", "market-share-report", "notice-of-meeting"):
        assert html_text.main_text(f"<div class='{name}'><h1>Title of it</h1><p>{p}</p><p>{p}</p></div>") == f"Title of it {p} {p}"
    odd = f"<article><p>{p}</p><p class='advert'>{p}</p><p hidden>no</p><h2 class='newsletter-title'>Join us</h2><p class=ad>x<br>y</p><p title='hidden gem'>{p}</p></article><div>{p}</div>"
    assert html_text.main_text(odd) == f"{p} {p}"
    assert html_text.main_text(f"<nav><a href=x>Home</a> <a href=y>News</a><h1>The title</h1><p>{p}</p><p>Yes.</p><p>{p}</p></body>") == f"The title {p} Yes. {p}"
    assert html_text.main_text(f"<article><h1><a href=x>A title</a></h1><p>{p}</p><ul><li><a href=a>One more</a><li><a href=b>Another</a></ul></article>") == f"A title {p}"
    assert html_text.main_text(f"<div class=siteHeader><p>{p}</p></div><main><div class=article-header><h1>Title</h1></div><p>{p}</p></main>") == f"Title {p}"


def test_tags_quotes_and_ends():
    p = PARAGRAPH
    assert html_text.main_text(f"<article><p title='a > b' data-x=\">\">{p}</p><p b='>{p}</p>") == f"{p} {p}"
    assert html_text.main_text(f"<article>{p}</section></div></article ><footer>{p}") == p
    assert html_text.main_text(f"<article>{p} < b <3 </ x> c <? y> d") == f"{p} < b <3 c d"
    assert html_text.main_text(f"<ARTICLE>{p}<SCRIPT>no</Script >{p}<p lost") == f"{p} {p}"


@pytest.mark.parametrize("unit", ["<a b='", "<a ", "<a b='>", "<svg/>", "<iframe/>", "<!--", "<div>", "</section><div>", "</", "&", "<x a=b", "='\"<a b=\"'>", "<p class='"])
def test_hostile_pages_take_linear_time(unit):
    import time

    began = time.process_time()
    html_text.main_text("<article>" + unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 3


P1, P2 = "Der Fluss trat gestern nach langem Regen über die Ufer und stand am Abend in den Kellern der alten Stadt. ", "Men worked all night to carry sand to the bridge, and by dawn the water had begun to fall again. "
#: What stands before a text, and after it, on pages without an article: names are no English words of the trade.
BEFORE = (
    "<div class=kopf><a href=/>Start</a> <a href=/n>Neues</a> <a href=/s>Sport</a></div>",
    "<div class=barre-haut><ul><li><a href=/>Accueil</a><li><a href=/a>À la une</a></ul></div><div class=bandeau>Abonnez-vous dès ce soir</div>",
    "<div id=cabezal><a href=/>Inicio</a></div><div class=aviso><p>Este sitio usa galletas para mejorar la visita de todos</p></div>",
    "<table><tr><td><a href=/>Home</a><td><a href=/i>Index</a></table>",
    "<div class=zzz>Heute 12 Grad, Regen</div>",
    "<div class=lang><a href=/de>Deutsch</a> <a href=/fr>Français</a></div>",
)
AFTER = (
    "<div class=fuss>Impressum und Datenschutz</div>",
    "<div class=werbung><p>Jetzt kaufen und zwei Tage lang sparen</p></div><div class=unten><a href=/k>Kontakt</a></div>",
    "<div class=pied>Tous droits réservés, mentions légales</div>",
    "<div class=user-opinions><p>Great read, thanks for it!</p><p>I was there and it was not like that at all.</p></div>",
    "<div class=abajo><h4>Más leídas</h4><ul><li><a href=/1>La lluvia vuelve el lunes</a><li><a href=/2>El puente cerrado</a></ul></div>",
    "",
)
TEXTS = (
    ("<h1>Hochwasser</h1><p>{0}</p><p>Ja.</p><p>{1}</p>", "Hochwasser {0}Ja. {1}"),
    ("<h1>The flood</h1><p>{1}</p><ul><li>sand<li>two boats<li>rope</ul><p>{0}</p>", "The flood {1}sand two boats rope {0}"),
    ("<p>Three men came.</p><p>Nobody saw them go.</p><p>It rained all night.</p>", "Three men came. Nobody saw them go. It rained all night."),
    ("{0}<br>{1}<br>Ende.<br>{0}", "{0}{1}Ende. {0}"),
    ("<h2>Crue</h2><p>{0} <a href=x>mehr davon hier</a> {1}</p><blockquote>Jamais vu.</blockquote><p>{1}</p>", "Crue {0}mehr davon hier {1}Jamais vu. {1}"),
    ("<h2><a href=x>El río</a></h2><p>{1}</p><h3>Después</h3><p>{0}</p><p>Fin.</p>", "El río {1}Después {0}Fin."),
)
SHORT = 2  # a text as short as what is around it


def test_pages_without_an_article():
    right = 0
    for b, before in enumerate(BEFORE):
        for t, (text, words) in enumerate(TEXTS):
            page = f"<html><body>{before}<div class=inhalt>{text.format(P1, P2)}</div>{AFTER[(b + t) % len(AFTER)]}</body></html>"
            if html_text.main_text(page) == words.format(P1, P2).strip():
                right += 1
            else:
                assert t == SHORT, page
    assert right >= 0.9 * len(BEFORE) * len(TEXTS)


def test_names_and_articles_can_be_overruled():
    p = "some words here " * 10 + "and there."
    inside = "<article><p>{0}</p><div class='{1}'><p>What others say of it</p></div><p>{0}</p></article>"
    for name in ("outbrain", "hinweis", "user-opinions", "Publicité", "comentarios-lista"):
        assert html_text.main_text(inside.format(p, name)) == f"{p} {p}", name
    for name in ("how-to-respond", "opinions", "the-avis", "share-of-markets"):
        assert html_text.main_text(inside.format(p, name)) == f"{p} What others say of it {p}", name
    assert html_text.main_text(f"<div id=how-to-respond><p>{p}</p><p>{p}</p></div><div>one of two small lines</div>") == f"{p} {p}"
    # teasers in articles beside a long text, links in an article
    teaser = "<article><h3><a href=x>Rain again on Monday</a></h3><p>It will be wet.</p></article>"
    assert html_text.main_text("<div><h1>The flood</h1>" + f"<p>{p}</p>" * 9 + f"</div>{teaser}{teaser}") == " ".join(["The flood"] + [p] * 9)
    assert html_text.main_text(f"<article><p>{p}</p><ul><li><a href=x>One more</a><li><a href=y>Two more</a></ul></article>") == p
    # an article keeps its few words beside many
    assert html_text.main_text(f"<div class=zzz>{'other words ' * 6}</div><article>Just these five words here</article>") == "Just these five words here"
    split = {f for f in _splits(html_text.TREE)}
    assert {"words", "link_density"} <= split and split & {"words_before", "words_after", "link_density_before", "link_density_after"}


def _splits(tree):
    if not isinstance(tree, bool):
        yield html_text.FEATURES[tree[0]]
        yield from _splits(tree[2])
        yield from _splits(tree[3])


def test_pages_whose_articles_are_renamed():
    import re

    import pyarrow.parquet as pq

    same = [html_text.main_text(h) == html_text.main_text(re.sub(r"<(/?)article\b", r"<\1div", h)) for h in pq.read_table(f"{DATA}/pages.parquet")["html"].to_pylist()]
    assert sum(same) >= 0.9 * len(same)


def test_deep_and_wide_pages():
    p = "some words here " * 10
    assert html_text.main_text("<div>" * 100_000 + p + "</div>" * 100_000) == p.strip()
    assert html_text.main_text(f"<div>{p}</div>" * 10_000).count("some") == 100_000


def test_extraction_query(spark):
    from html.parser import HTMLParser

    class Model(HTMLParser):
        """The words in the article, by another parser."""

        def __init__(self):
            super().__init__()
            self.inside, self.parts = False, []

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            self.parts.append(" " if tag in ("p", "br", "h1") else "")

        def handle_endtag(self, tag):
            self.inside = self.inside and tag != "article"
            self.parts.append(" " if tag in ("p", "h1") else "")

        def handle_data(self, data):
            self.parts.append(data if self.inside else "")

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in queries.op10_html(spark, DATA).collect():
        model = Model()
        model.feed(pages[r["page_id"]])
        assert r["text"] == " ".join("".join(model.parts).split())
        assert r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, None, None, 3), (None, "u", "<article>x y", None)], "page_id long, url string, html string, row int")
    assert sorted(map(str, (tuple(r) for r in html_text.extracted(odd).collect()))) == sorted(map(str, [(1, None, 3, "", 0), (None, "u", None, "x y", 3)]))
    assert html_text.extracted(odd.limit(0)).count() == 0


@pytest.mark.parametrize("f", [lambda d: d.where(F.lit(False))])
def test_empty_pipeline_input(spark, f):
    import corpus_pipeline

    docs = f(spark.read.parquet(f"{DATA}/documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
