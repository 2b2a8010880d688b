"""Clusters, divergences and licences against plain Python, and their defined cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from contigua.llm import clustering, divergence, licenses

# clusters


def plain_clusters(rows, k, rounds, dims):
    v = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in v if i is not None)[:k]
    c = [q for _, q in first]
    nearest = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [nearest(q)[1] for _, q in v]
        for j in range(len(c)):
            own = [q for (_, q), o in zip(v, of) if o == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(q)) for i, q in v]
    of = Counter()
    for _, d, j in found:
        of[j] += d
    return sorted(((i, j, d, of[j], sum(of.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, "x", 1.0) for i, e in rows], "vec_id long, embedding array<float>, q string, cluster double").repartition(3)


@pytest.mark.parametrize("spread", [0.02, 0.5, 3.0])
def test_clusters_like_plain_python(spark, spread):
    rng = random.Random(5)
    near = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, spread))) for x in rng.choice(near)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # copies and ties
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (2000, None), (2001, [1.0]), (2002, [None] * 8), (2003, [float("nan")] * 8), (2004, [float("inf")] + [0.0] * 7)]
    found = clustering.clustered(vectors(spark, rows), k=11, rounds=4, dims=8)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_clusters(rows, 11, 4, 8)


def test_clusters_of_few_or_no_vectors(spark):
    few = [(i, [float(i), 0.0]) for i in range(3)]
    assert sorted(tuple(r) for r in clustering.clustered(vectors(spark, few), dims=2).collect()) == plain_clusters(few, 16, 3, 2)
    for rows in ([], [(1, None)], [(None, [1.0, 1.0])]):
        found = clustering.clustered(vectors(spark, rows), dims=2)
        assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and found.count() == 0
    with pytest.raises(Exception, match="too large"):
        clustering.clustered(vectors(spark, [(7, [1e12, 0.0])]), dims=2)


def test_filters_spare_distances_and_change_nothing():
    rng = np.random.default_rng(3)
    of_x = rng.integers(0, 30, 3000)
    x = (rng.normal(0, 400, (30, 16))[of_x] + rng.normal(0, 10, (3000, 16))).astype(np.int64)
    c = x[rng.choice(3000, 24, replace=False)]
    of = clustering.grouped(c)
    assert of.max() > 0
    s, taken = clustering.first_state(x, c, of), 0
    for _ in range(5):
        new = np.stack([x[s.cluster == j].sum(axis=0) // max(1, (s.cluster == j).sum()) if (s.cluster == j).any() else c[j] for j in range(len(c))])
        s, n = clustering.next_state(s, x, new, of, ((new - c) ** 2).sum(axis=1))
        c, taken = new, taken + n
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (s.cluster == d.argmin(axis=1)).all()
        own = np.sqrt(d[np.arange(len(x)), s.cluster])
        assert (s.upper >= own * (1 - 1e-12)).all()
        for g in range(of.max() + 1):
            others = np.where((of == g)[None] & (np.arange(len(c))[None] != s.cluster[:, None]), d, np.inf).min(axis=1)
            assert (s.lower[:, g] <= np.sqrt(others) * (1 + 1e-12)).all()
    assert taken < 0.35 * 5 * len(x) * len(c)


def test_distances_of_large_components_are_exact():
    x = np.array([[1 << 26, -(1 << 26)], [3, 5]], np.int64)
    c = np.array([[-(1 << 26), 1 << 26], [3, 4]], np.int64)
    assert clustering.squared(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]


# divergences

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans(licenses.CAPITALS, licenses.SMALL)


def plain_audit(rows, least, top):
    counts, docs, n_docs = defaultdict(Counter), defaultdict(Counter), Counter()
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(ASCII))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
        n_docs[lang or ""] += 1
    out = []
    for lang in n_docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        groups = {s: c for (a, s), c in counts.items() if a == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s in groups:
            pair = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s))
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pair), ("term", term)):
                out += [(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)]
    return sorted(out)


def texts(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1, 2) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int, at int").repartition(4)


@pytest.mark.parametrize("sizes", [{}, {"chunk": 4, "block": 2, "span": 2}, {"chunk": 1, "block": 1, "span": 1}])
def test_audit_like_plain_python(spark, sizes):
    rng = random.Random(9)
    words = [rng.choice(("w", "É", "ß", "漢", "Q")) + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(40)]
    rows = [(rng.choice((" ", "\x00", "-1", "\x85 ")).join(rng.choices(words, range(1, 41), k=rng.randrange(30))), rng.choice(("en", "de", None)), rng.choice(("a", "b", "é", "ｚ", "𝔘", None, ""))) for _ in range(300)]
    rows += [(None, "en", "only-nulls"), ("", "xx", "lone"), ("abc", "yy", "s1"), ("abd", "yy", "s2"), *[("Same same SAME", "en", "a")] * 20, ("hot " * 5000, "en", "a")]
    found = divergence.audited(texts(spark, rows), least=6, top=5, **sizes)
    assert sorted(tuple(r) for r in found.collect()) == plain_audit(rows, 6, 5)


def test_audit_of_nothing(spark):
    assert divergence.audited(texts(spark, [])).collect() == []


def test_terms_of_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 7)
    rng = random.Random(2)
    for _ in range(50):
        text = "".join(rng.choice("aB é-\n漢") for _ in range(rng.randrange(60)))
        assert {t.decode(): n for t, n in divergence._terms(text.encode()).items()} == Counter(TERM.findall(text.translate(ASCII)))


def test_shares_of_large_counts():
    n, total, terms = 8_000_000_000_000_000 - 7, 8_900_000_000_000_000, 1_000_000
    assert divergence.shares(np.array([0, n]), total, terms).tolist() == [1 + 10**9 * (x + 5) // (total + 5 * terms) for x in (0, n)]


# licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_scan(rows):
    words = [WORD.findall((t or "").translate(ASCII)) for _, t in rows]
    df = Counter(w for ws in words for w in set(ws))
    out = []
    for (key, _), ws in zip(rows, words):
        base = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        labels, score = {x for _, x in base}, 0.0
        for t in licenses.TEMPLATES:
            n = len(t.words)
            rare = set(sorted(set(t.words), key=lambda w: (df[w], w))[: licenses.RARE])
            at = [p for p, w in enumerate(t.words) if w in rare]
            for o in range(-n, len(ws)):
                there = lambda p, o=o, t=t, ws=ws: 0 <= o + p < len(ws) and ws[o + p] == t.words[p]
                if 2 * sum(map(there, at)) < len(at):
                    continue
                around = lambda p, m, o=o, ws=ws: " " + " ".join(ws[max(0, o + p - licenses.SLACK) : max(0, o + p + m + licenses.SLACK)]) + " "
                if all(f" {key_} " in around(p, m) for p, m, key_ in t.places()):
                    labels.add(t.label)
                    score = max(score, sum(map(there, range(n))) / n)
        places = [i for i, _ in base]
        out.append((key, len(ws), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1.0 if base else score))
    return sorted(out, key=str)


def files(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "k") for i, t in rows], "doc_id long, text string, labels string, t int, _words string").repartition(3)


def test_scan_like_plain_python(spark):
    rng = random.Random(4)
    vocabulary = licenses.vocabulary()
    texts_ = [None, "", " \n\x00", "CC-BY", "cc by cc by, CC BY", "All Rights\nReserved.", "all rights all rights reserved", "É cc by", "ccc by", "mit license", "Released under the MIT License."]
    for t in licenses.TEMPLATES:
        w = t.words
        texts_ += [t.text.upper(), "# " + "\n# ".join(w) + ".", " ".join(w[: len(w) // 2]), " ".join(w[:3] + ["Some", "Holder"] + w[3:]), " ".join(w[1:]), f"x y z {t.text} a b {t.text}", " ".join(x for x in w if x != w[-1])]
    texts_ += [" ".join(rng.choices(vocabulary, k=rng.randrange(80))) for _ in range(150)] + ["license under " * 3000 + "released under the mit license"]
    rows = [*enumerate(texts_), (None, "all rights reserved"), (5, texts_[5])]
    found = licenses.scan(files(spark, rows))
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_scan(rows)
    labels = {r["doc_id"]: r["labels"].split(",") for r in found.collect()}
    for i, t in enumerate(licenses.TEMPLATES):
        assert all(t.label in labels[11 + 7 * i + j] for j in (0, 1, 5))


def test_scan_of_nothing_and_plan(spark):
    assert licenses.scan(files(spark, [])).collect() == []
    plan = licenses.scan(files(spark, [(1, "all rights reserved")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
