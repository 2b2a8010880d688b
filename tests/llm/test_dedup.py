"""Suffix dedup, line dedup and SimHash against brute force, and their defined cases."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from contigua.llm import line_dedup, near_dups, queries, simhash, suffix_dedup
from contigua.llm.common import joined
from contigua.llm.components import components

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, version string, key int, n_removed string"


def documents(spark, rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "v", None, "x") for i, t in rows], DOCS).repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def suffix_model(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((k, len(b), sum(gone), sum(gone[j] and not (j and gone[j - 1]) for j in range(len(b))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd") for _ in range(300)) for _ in range(6)]
    rows = []
    for i in range(100):
        t = ""
        for _ in range(rng.randrange(1, 5)):
            a = rng.randrange(200)
            t += rng.choice(base)[a : a + rng.randrange(20, 200)] + "".join(rng.choice("abcd") for _ in range(rng.randrange(30)))
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, "a" * 500), (203, "ab" * 300), (None, rows[3][1]), (3, rows[3][1]), (204, "x" * 39), (205, "y" * 40 + "z" + "y" * 40), (206, "é" * 60)]
    df, expected = documents(spark, rows), suffix_model(rows, 40)
    assert sum(r[2] for r in expected) > 0
    for group in (20_000, 3):
        for core in (13, 20):
            assert rows_of(suffix_dedup.deduplicated(df, length=40, core=core, group=group)) == expected


def test_suffix_dedup_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op1_suffix_dedup(spark, DATA)) == suffix_model(rows, 400)


def test_planted_passages_above_and_below_the_length(spark):
    """Passages of over 50 words that two documents share: those of 400 bytes or more go from both, shorter ones stay, and so does all around them."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    rows, planted = [], {}
    for i in range(120):
        size = rng.randrange(400, 900) if i % 2 else rng.randrange(300, 400)
        passage = (words(51) + " " + words(120))[:size]
        for j, (a, b) in enumerate((("<", ">"), ("[", "]"))):  # what stands beside it differs
            key = 2 * i + j
            planted[key] = (size, f"{words(rng.randrange(5, 60))}{a}", passage, f"{b}{words(rng.randrange(5, 60))}")
            rows.append((key, "".join(planted[key][1:])))
    rows += [(1000 + i, words(150)) for i in range(60)]
    found = {r["doc_id"]: r for r in suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    for key, text in rows:
        size, before, _, after = planted.get(key, (0, "", "", ""))
        gone = size >= 400
        left = before + after if gone else text
        assert (found[key]["n_bytes"], found[key]["n_removed"], found[key]["n_spans"]) == (len(text), size if gone else 0, int(gone))
        assert found[key]["kept_sha256"] == hashlib.sha256(left.encode()).hexdigest()


def test_suffix_dedup_parts_and_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 64)
    a, b = (suffix_dedup.zones(bytes(random.Random(2).choices(b"abcdef", k=600)), 40, 13) for _ in range(2))
    assert all((x == y).all() for x, y in zip(a, b, strict=True))
    covered = [s for f, n in zip(a[0], a[2], strict=True) for s in range(f, f + n + 1)]
    assert covered == list(range(600 - 40 + 1))
    df = documents(spark, [(1, "q" * 50 + "x" * 10), (2, "q" * 50)])
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.deduplicated(df, length=40, core=13, with_text=True).collect()}
    assert kept == {1: b"x" * 10, 2: b""}


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.deduplicated(documents(spark, [])).count() == 0


def test_merging_and_front_coding():
    rng = random.Random(4)
    runs, items = [], []
    for r in range(7):
        part = sorted((bytes(rng.choices(b"ab", k=rng.randrange(0, 60))), bytes([r])) for _ in range(rng.randrange(0, 40)))
        items += part
        runs.append(suffix_dedup.front_coded(part))
    found = list(suffix_dedup.merged(runs))
    assert [s for _, s, _ in found] == sorted(s for s, _ in items)
    assert sorted((s, rest) for _, s, rest in found) == sorted(items)
    for (_, a, _), (k, b, _) in zip(found, found[1:], strict=False):
        assert k == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert list(suffix_dedup.merged([])) == []


def test_large_groups_agree_with_pairs():
    rng = random.Random(9)
    entries, strings = [], []
    for i in range(60):
        left, right = bytes(rng.choices(b"ab", k=rng.randrange(0, 6))), bytes(rng.choices(b"ab", k=14))
        strings.append((right, left, i))
    strings.sort()
    prefixes = [0] + [suffix_dedup.common_prefix(a[0], b[0]) for a, b in zip(strings, strings[1:], strict=False)]
    entries = [(left, len(left), 0, False, (i,)) for _, left, i in strings]
    spread = lambda found: {(i, k) for i, high, low in found for k in range(low, high + 1)}
    numpy_way = spread(suffix_dedup.repeated(prefixes, entries, 10))
    window = lambda s, k: (k, s[1][:k], s[0][: 10 - k])
    seen = Counter(window(s, k) for s in strings for k in range(len(s[1]) + 1))
    assert numpy_way == {(i, k) for i, s in enumerate(strings) for k in range(len(s[1]) + 1) if seen[window(s, k)] > 1}


def test_line_dedup_cases(spark):
    rows = [
        (1, "a\nb\nc\nd"),
        (2, "x\na\n\nb\nc\ny"),
        (3, "a\nb"),
        (4, None),
        (5, ""),
        (None, "a\nb\nc"),
        (6, "e\ne\ne\ne\ne"),
        (7, "p\nq\nr"),
        (7, "p\nq\nr"),
        (8, "\n \n\t\n"),
        (9, "b\nc\nd\nz"),
    ]
    found = line_dedup.deduplicated(documents(spark, rows))
    assert found.columns == ["doc_id", "text", "version", "key", "n_removed", "n_lines"]
    text = {(r["doc_id"], r["text"]) for r in found.collect()}
    assert text == {(1, "a\nb\nc\nd"), (2, "x\n\ny"), (3, "a\nb"), (4, None), (5, ""), (None, "a\nb\nc"), (6, "e"), (7, "p\nq\nr"), (8, "\n \n\t\n"), (9, "z")}
    assert found.count() == len(rows)
    assert line_dedup.deduplicated(documents(spark, [])).count() == 0


def test_line_dedup_matches_sql(spark):
    duckdb_rows = duckdb.connect()
    duckdb_rows.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    found = queries.op6_line_dedup(spark, DATA)
    expected = duckdb_rows.sql(queries.oracle_sql()["op6_line_dedup"]).select(*found.columns).fetchall()
    assert rows_of(found) == sorted(expected, key=str)


def model_fingerprint(text, size=3):
    words = (text or "").encode().translate(simhash.LOWER).split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def linked(fps, most):
    above = list(range(len(fps)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = root(i), root(j)
                above[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(50)] + ["É", "ÀB"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    texts += [texts[1], texts[2] + " tail", None, "", "  \n", "One", "ONE", "a b", "A\tB"]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    found = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_groups(documents(spark, rows + [(None, "One")])).collect()}
    fps = [model_fingerprint(t) for t in texts]
    assert {k: v[0] for k, v in found.items() if k is not None} == {i * 3: f for i, f in enumerate(fps)}
    roots = linked(fps, 2)
    assert {k: v[1] for k, v in found.items() if k is not None} == {i * 3: r * 3 for i, r in enumerate(roots)}
    assert found[None][1] is None
    assert simhash.near_groups(documents(spark, [])).count() == 0


def test_near_pairs_in_small_ranges(spark):
    rng = random.Random(3)
    fps = set()
    for c in [rng.getrandbits(64) for _ in range(2)]:
        for _ in range(40):
            x = c
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    place = {s: i for i, s in enumerate(signed)}
    for limit in (4096, 20):
        pairs = simhash.near_pairs(spark.createDataFrame([(s,) for s in signed], "fp long"), 2, limit).collect()
        assert all((fps[place[p["a"]]] ^ fps[place[p["b"]]]).bit_count() <= 2 for p in pairs)
        above = linked(fps, 2)
        joined = list(range(len(fps)))
        for p in pairs:
            a, b = place[p["a"]], place[p["b"]]
            x, y = joined[a], joined[b]
            joined = [min(x, y) if j in (x, y) else j for j in joined]
        assert joined == above


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 62, 900, dtype=np.uint64) & np.uint64(0x3FF))
    fps = np.unique(np.concatenate([fps, fps ^ np.uint64(1 << 40)]))
    found = {(min(a, b), max(a, b)) for x, y in simhash.GrayIndex(fps).pairs(2) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert found == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2}


def test_upper_nodes_prune_groups_of_the_table(spark):
    fps = np.array(sorted({r["fp"] for r in simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()}), np.int64).view(np.uint64)
    index = simhash.GrayIndex(fps)
    found = {(min(a, b), max(a, b)) for x, y in index.pairs(2) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    # the set of queries: every hundredth fingerprint, against all
    for q in range(0, len(fps), 100):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[q]) <= 2)
        assert {(min(q, j), max(q, j)) for j in near.tolist() if j != q} <= found
    assert len(index.looked) > 5 and index.looked[0] < len(fps) * len(fps) / 200


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(5, 5), (None, 3)]
    root = {}
    for a, b in edges:
        if a is not None:
            x, y = root.setdefault(a, a), root.setdefault(b, b)
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    for few in (0, 50_000):
        found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3), few).collect()}
        assert found == {k: v for k, v in root.items() if k != v}
        assert components(spark.createDataFrame([], "a long, b long"), few).count() == 0


def test_resembling_groups_match_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    words = ["w%d" % i for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randrange(30, 150))] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(8):
            w = list(b)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    texts += [None, "", "one two", "One TWO", "x"]
    sets = [frozenset(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    above = list(range(len(sets)))
    for i, j in ((i, j) for i in range(len(sets)) for j in range(i)):
        if not sets[i] | sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = above[i], above[j]
            above = [min(a, b) if x in (a, b) else x for x in above]
    df = documents(spark, list(enumerate(texts)) + [(None, texts[0])])
    found = {r["doc_id"]: r["component_id"] for r in near_dups.resembling_groups(df).collect()}
    assert found == dict(enumerate(above))
    assert near_dups.one_of_each(df).where("doc_id is not null").count() == len(set(above))
    assert near_dups.resembling_groups(documents(spark, [])).count() == 0


def family(rng, count, shared, own, planted):
    """Texts of one template; the first two times `planted` are pairs that also share a part of their own words."""
    new = lambda n: ["%x" % rng.getrandbits(60) for _ in range(n)]
    template, half = new(shared), [new(own // 3) for _ in range(planted)]
    return [" ".join(template + (half[i // 2] + new(own - own // 3) if i < 2 * planted else new(own))) for i in range(count)]


def groups_of(spark, texts):
    found = {}
    for r in near_dups.resembling_groups(documents(spark, list(enumerate(texts)))).collect():
        found.setdefault(r["component_id"], []).append(r["doc_id"])
    return sorted(sorted(g) for g in found.values() if len(g) > 1)


def test_texts_below_the_bound_are_not_linked(spark):
    texts = family(random.Random(21), 120, 404, 54, 0)
    assert 0.78 < near_dups.resemblance(texts[0].encode(), texts[1].encode(), 5) < 0.79
    assert groups_of(spark, texts) == []


def test_repeated_shingles_count_once(spark):
    rng = random.Random(22)
    new = lambda n: ["%x" % rng.getrandbits(60) for _ in range(n)]
    one, other, third = new(800), new(920), new(920)
    texts = [" ".join(w + ["0"] * n) for w, n in ((one, 5), (one, 204), (other, 84), (third, 84))]
    assert groups_of(spark, texts) == [[0, 1]]


def test_pairs_within_a_template_are_linked(spark):
    texts = family(random.Random(23), 300, 404, 54, 30)
    assert 0.83 < near_dups.resemblance(texts[0].encode(), texts[1].encode(), 5) < 0.86
    assert groups_of(spark, texts) == [[i, i + 1] for i in range(0, 60, 2)]


def test_large_groups_are_compared_whole(spark):
    texts = family(random.Random(24), 9000, 104, 14, 60)
    assert groups_of(spark, texts) == [[i, i + 1] for i in range(0, 120, 2)]


def test_prefixes_and_sketches_lose_no_pair():
    rng = np.random.default_rng(25)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, rng.integers(20, 60), replace=False), rng.integers(0, 1 << 63, rng.integers(0, 4), dtype=np.uint64)]) for _ in range(150)]
    common = rng.integers(0, 3, 1 << near_dups.CELL_BITS)
    true = {(i, j) for j in range(len(sets)) for i in range(j) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert true
    rows = np.array([(s.view(np.int64), i, i, len(x), p, 0, *near_dups.parity(x)) for i, x in enumerate(sets) for p, s in enumerate(near_dups.prefix(x, common, 0.8))])
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    assert true <= {tuple(sorted(p)) for x in near_dups.cross_pairs(rows, 0.8) for p in x.tolist()}
    met, above = near_dups.trees(rows, 0.8)
    assert len(above) == near_dups.TREES and any((met[:, near_dups.NODE] != x).any() for x in above)
    # across halves only pairs of both, none of linked nodes
    rows[:, near_dups.HALF] = 1 + rows[:, near_dups.NODE] % 2
    rows[:, near_dups.ROOT] = rows[:, near_dups.NODE] // 4
    across = {tuple(sorted(p)) for x in near_dups.cross_pairs(rows, 0.8) for p in x.tolist()}
    assert {(i, j) for i, j in true if (i - j) % 2 and i // 4 != j // 4} <= across
    assert all((i - j) % 2 and i // 4 != j // 4 for i, j in across)


def test_groups_do_not_depend_on_blocks_or_partitions(spark):
    texts = family(random.Random(27), 200, 404, 54, 20) + family(random.Random(28), 60, 200, 2, 0)
    df = documents(spark, list(enumerate(texts)))
    found = [rows_of(near_dups.resembling_groups(d, block=b)) for d, b in ((df, near_dups.BLOCK), (df.repartition(7), 16), (df.coalesce(1), 64))]
    assert found[0] == found[1] == found[2]
    assert sum(1 for r in found[0] if r[1] == 200) == 60 and len({r[1] for r in found[0]}) == 181


def test_unrelated_texts_of_equal_fingerprints_both_stay(spark):
    rng = random.Random(29)
    new = lambda n: ["%x" % rng.getrandbits(60) for _ in range(n)]
    spam = "buy cheap pills now at our shop today\n" * 500
    df = documents(spark, [(i, spam + " ".join(new(400))) for i in (1, 2)])
    assert near_dups.one_of_each(df).count() == 2


def test_repeated_keys_leave_one_row_of_each_group(spark):
    rng = random.Random(26)
    a, b, c, d = (" ".join("%x" % rng.getrandbits(60) for _ in range(40)) for _ in range(4))
    # 2 twice with a text, 3 with a copy of 1's text and with one of its own, 4 with two texts of one group
    df = documents(spark, [(1, a), (2, b), (2, b), (3, a), (3, c), (4, d), (4, d + " tail"), (None, a), (None, a)])
    left = [(r["doc_id"], r["text"].removesuffix(" tail")) for r in near_dups.one_of_each(df).collect()]
    assert sorted(left, key=str) == sorted([(1, a), (2, b), (3, c), (4, d), (None, a), (None, a)], key=str)


@settings(deadline=None)
@given(st.lists(st.text(st.sampled_from("aAb é\t\n\x0b\x00\x85"), max_size=90), max_size=4), st.integers(1, 6))
def test_rolled_hashes_tell_shingles_apart_as_their_words_do(parts, size):
    texts = [p.encode() for p in parts] + [" ".join(parts).encode(), b"a" * 32, b"A" * 33 + b" b", b""]
    words = [t.translate(simhash.LOWER).split() for t in texts]
    shingles = [[tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))] if w else [] for w in words]
    hashes = [near_dups.rolled_hashes(t, size).tolist() for t in texts]
    assert [len(h) for h in hashes] == [len(s) for s in shingles]
    pairs = {(s, h) for ss, hh in zip(shingles, hashes, strict=True) for s, h in zip(ss, hh, strict=True)}
    assert len(pairs) == len({s for s, _ in pairs}) == len({h for _, h in pairs})


def test_rows_of_hot_keys_meet_a_broadcast(spark):
    rows = [("hot", i) for i in range(600)] + [("warm", i) for i in range(40)] + [(f"k{i % 150}", i) for i in range(300)] + [("lost", 1), (None, 2)]
    one = [("hot", 600, 1), ("warm", 40, 2), *((f"k{i}", 2, 3 + i) for i in range(150))]
    df, ones = spark.createDataFrame(rows, "fp string, i int").repartition(4), spark.createDataFrame(one, "fp string, n long, x int")
    label = {k: x for k, _, x in one}
    for hot in (1, 10, 1024):
        found = joined(df, ones, "fp", hot=hot)
        assert found.columns == ["fp", "i", "x"]
        assert sorted(map(tuple, found.collect())) == sorted((k, i, label[k]) for k, i in rows if k in label), hot
    assert joined(df, ones.limit(0), "fp").count() == 0 and joined(df.limit(0), ones, "fp").count() == 0
