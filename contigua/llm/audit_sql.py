"""SQL of the centroid, divergence and licence queries: what these must return, in plain joins and without their methods."""

from __future__ import annotations

from contigua.llm import clustering, divergence, licenses


def centroids_sql(k: int = clustering.K, rounds: int = clustering.ROUNDS, dims: int = clustering.DIMS, scale: int = clustering.SCALE) -> str:
    tables = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
        WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = {dims})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('1:', vec_id)), q) - 1 AS c, q FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k})""",
    ]
    for i in range(rounds + 1):
        distance = "CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
        tables.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, min({distance} * {k} + c) AS m FROM v, c{i} AS c GROUP BY r)")
        if i < rounds:
            sums = f"SELECT m % {k} AS c, j, CAST(sum(q[j]) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, {dims + 1}) AS t(j) GROUP BY ALL"
            tables.append(f"m{i} AS (SELECT c, list((s - (s % n + n) % n) // n ORDER BY j) AS q FROM ({sums}) AS s GROUP BY c)")
            tables.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} USING (c))")
    last = rounds
    return f"""WITH {", ".join(tables)}
    SELECT vec_id, CAST(m % {k} AS INT) AS cluster, CAST(m // {k} AS BIGINT) AS distance, CAST(sum(m // {k}) OVER (PARTITION BY m % {k}) AS BIGINT) AS cluster_inertia,
      CAST(sum(m // {k}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(q, ',')) AS centroid_sha256
    FROM a{last} JOIN c{last} ON c = m % {k}"""


def divergence_sql(least: int = divergence.LEAST, top: int = divergence.TOP) -> str:
    p = lambda n, total: f"1 + CAST(({divergence.BILLION}::HUGEINT * ({n} + {divergence.SMOOTH})) // ({total} + {divergence.SMOOTH} * v) AS BIGINT)"
    return f"""
    WITH d AS (
      SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), '{licenses.CAPITALS}', '{licenses.SMALL}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
    ), c AS MATERIALIZED (
      SELECT lang, source, term, sum(n) AS n, count(*) AS docs FROM (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) AS u GROUP BY ALL) AS e GROUP BY ALL
    ), kept AS MATERIALIZED (
      SELECT lang, term, sum(n) AS n, count(*) OVER (PARTITION BY lang) AS v, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM c GROUP BY lang, term HAVING sum(docs) >= {least}
    ), g AS (SELECT DISTINCT lang, source FROM d),
    full_ AS MATERIALIZED (
      SELECT g.lang, g.source, kept.term, v, coalesce(c.n, 0) AS n, kept.n AS lang_n, kept.total AS lang_total, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
      FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
    ), shares AS MATERIALIZED (
      SELECT lang, source, term, n, {p("n", "total")} AS p, {p("lang_n", "lang_total")} AS q FROM full_
    ), pairs AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
      FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN shares AS x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares AS y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
      GROUP BY a.lang, a.source, b.source
    ), found AS (
      SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q
    )
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM found QUALIFY part = 'pair' OR rank <= {top}"""


def licenses_sql(templates: tuple[licenses.Template, ...] = licenses.TEMPLATES, rare: int = licenses.RARE, slack: int = licenses.SLACK) -> str:
    rows = lambda values: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in v) + ")" for v in values)
    words = rows((t, p, w) for t, x in enumerate(templates) for p, w in enumerate(x.words))
    keys = rows((t, at, n, key) for t, x in enumerate(templates) for at, n, key in x.places())
    labels = rows((t, x.label, len(x.words)) for t, x in enumerate(templates))
    here = lambda phrase: " AND ".join(f"d.w[x.i + {k}] = '{w}'" for k, w in enumerate(phrase.split(), 1))
    base = " UNION ALL ".join(f"SELECT x.r, x.i, '{label}' AS label FROM words AS x JOIN d USING (r) WHERE x.w = '{p.split()[0]}' AND {here(p)}" for p, label in licenses.PHRASES.items())
    return f"""
    WITH d AS MATERIALIZED (
      SELECT row_number() OVER () AS r, doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), '{licenses.CAPITALS}', '{licenses.SMALL}'), '{licenses.GAP}', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents
    ), words AS MATERIALIZED (SELECT r, unnest(w) AS w, unnest(range(0, len(w))) AS i FROM d),
    tw(t, p, w) AS (VALUES {words}), keys(t, place, n, key) AS (VALUES {keys}), labels(t, label, size) AS (VALUES {labels}),
    df AS (SELECT s.w, count(DISTINCT r) AS n FROM (SELECT DISTINCT w FROM tw) AS s LEFT JOIN words USING (w) GROUP BY s.w),
    rare AS (SELECT t, w FROM (SELECT DISTINCT t, w FROM tw) AS s JOIN df USING (w) QUALIFY row_number() OVER (PARTITION BY t ORDER BY n, w) <= {rare}),
    postings AS (SELECT t, p, w FROM tw JOIN rare USING (t, w)),
    need AS (SELECT t, (count(*) + 1) // 2 AS m FROM postings GROUP BY t),
    votes AS (SELECT r, t, i - p AS o, count(*) AS n FROM words JOIN postings USING (w) GROUP BY ALL),
    candidates AS (SELECT r, t, o FROM votes JOIN need USING (t) WHERE n >= m),
    passed AS (
      SELECT r, t, o FROM candidates JOIN keys USING (t) JOIN d USING (r) GROUP BY r, t, o
      HAVING bool_and(contains(concat(' ', array_to_string(w[greatest(1, o + place - {slack} + 1):greatest(0, o + place + n + {slack})], ' '), ' '), concat(' ', key, ' ')))
    ), covered AS (
      SELECT r, t, o, count(*) FILTER (WHERE o + p >= 0 AND d.w[o + p + 1] = tw.w) AS n FROM passed JOIN d USING (r) JOIN tw USING (t) GROUP BY r, t, o
    ), base AS MATERIALIZED ({base}),
    of_base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM base GROUP BY r),
    joined AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM base GROUP BY r),
    more AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM passed JOIN labels USING (t)) AS a GROUP BY r),
    shares AS (SELECT r, max(CAST(n AS DOUBLE) / size) AS score FROM covered JOIN labels USING (t) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(joined.s, '') AS base_labels, coalesce(more.s, '') AS labels,
      CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
    FROM d LEFT JOIN of_base USING (r) LEFT JOIN joined USING (r) LEFT JOIN more USING (r) LEFT JOIN shares USING (r)"""
