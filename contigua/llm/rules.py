"""Quality rules: base statistics in native expressions, and learned decision lists over them.

A decision list is learned by sequential covering from labelled statistics: a rule, a conjunction of
thresholds, grows by the largest information gain on two thirds of the rows, loses its last conditions
where that helps on the other third, and is kept if it is precise there; the rows that it covers leave and
the next rule follows. The list becomes one ordered Spark conditional expression. Statistics, learning input
and verdict are DataFrame expressions; the driver only sees numbers of a bounded sample of labelled rows.

Defined cases: a null text has no words and fails the base rule, as every text of fewer than MIN_WORDS
words; rows are judged one by one, so repeated rows get repeated results; a null label teaches
nothing; without labelled rows of both kinds the list is empty and only the base rule counts. Other
columns are kept as they are; a column named like a statistic is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.llm.common import SPACES, WORD_GAP

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
#: Labelled rows that a list is learned from at most: those with the smallest hashes of doc_id.
SAMPLE = 8000
#: Thresholds tried for a statistic, at equal shares of its values.
THRESHOLDS = 64
#: Precision on the pruning third that a rule needs.
PRECISION = 0.8
STATISTICS = ("n_words", "n_repeat_words", "n_lines", "n_dup_lines", "word_chars", "n_symbols", "n_pipes", "n_marks", "n_capitals", "n_digits")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Statistics that rules put thresholds on; none needs more than the columns of with_statistics().
RATIOS = {
    "symbols_per_word": "n_symbols / n_words",
    "pipes_per_word": "n_pipes / n_words",
    "marks_per_word": "n_marks / n_words",
    "capitals_per_char": "n_capitals / word_chars",
    "digits_per_char": "n_digits / word_chars",
    "chars_per_word": "word_chars / n_words",
    "repeated_share": "n_repeat_words / n_words",
    "dup_lines_per_line": "n_dup_lines / n_lines",
    "words_per_line": "n_words / n_lines",
}


def _count_of(chars: str, text: str = "_text") -> Column:
    return (F.char_length(F.col(text)) - F.char_length(F.translate(F.col(text), chars, ""))).cast("long")


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the statistics of each whole text, all long."""
    get = F.get
    df = df.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn("_trim", F.btrim(F.col("_text"), F.lit(SPACES)))
    df = df.withColumn("_words", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", WORD_GAP, -1)))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    lines = F.filter(F.split(F.col("_text"), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.withColumn("_lines", lines).withColumn("_hashes", F.when(F.col("n_words") > WINDOW, F.transform("_words", lambda w: F.xxhash64(w))))
    at = F.sequence(F.lit(0), F.size("_hashes") - WINDOW)
    df = df.withColumn("_windows", F.when(F.col("_hashes").isNotNull(), F.transform(at, lambda i: F.xxhash64(*(get(F.col("_hashes"), i + k) for k in range(WINDOW))))))
    # most texts repeat nothing: their windows are not sorted
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("_sorted")
    same = lambda j, k: F.coalesce(get(s, j)["h"] == get(s, k)["h"], F.lit(False))
    twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
    df = df.withColumn("_starts", F.when(s.isNotNull(), F.sort_array(F.transform(twice, lambda j: get(s, j)["i"]))))
    covered = F.aggregate(
        F.col("_starts"),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("n"), i.alias("at")),
        lambda acc: acc["n"],
    )
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    df = df.withColumns(
        {
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "word_chars": F.char_length(F.translate(F.col("_text"), SPACES, "")).cast("long"),
            "n_symbols": _count_of(SYMBOLS),
            "n_pipes": _count_of("|"),
            "n_marks": _count_of("!?"),
            "n_capitals": _count_of(letters),
            "n_digits": _count_of("0123456789"),
        }
    )
    df = df.drop("_text", "_trim", "_words", "_lines", "_hashes", "_windows", "_sorted", "_starts")
    # a filter is not pushed below a column that is not deterministic: else it would be written out in terms of the text, again and again
    marked = df.withColumn("_mark", F.monotonically_increasing_id())
    return marked.withColumns({c: F.when(F.col("_mark") >= 0, F.col(c)) for c in STATISTICS}).drop("_mark")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    stat: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.stat] > self.threshold if self.above else x[self.stat] <= self.threshold

    def column(self) -> Column:
        value = F.try_divide(*(F.col(c) for c in RATIOS[self.stat].split(" / ")))
        return F.coalesce(value > self.threshold if self.above else value <= self.threshold, F.lit(False))


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Conditions by the largest information gain until no good row is covered or none gains."""
    rule, inside = (), np.ones(len(bad), bool)
    while (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        best, most = None, 1e-9
        for stat, v in x.items():
            cuts = np.unique(np.quantile(v[inside], np.linspace(0, 1, THRESHOLDS)))
            for t in (cuts[1:] + cuts[:-1]) / 2:
                high = v > t
                for above, hit in ((True, inside & high), (False, inside & ~high)):
                    q, m = (hit & bad).sum(), (hit & ~bad).sum()
                    if q and (gain := q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))) > most:
                        best, most = Condition(stat, above, float(t)), gain
        if best is None:
            break
        rule, inside = (*rule, best), inside & best.holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float]:
    """The beginning of the rule that is worth most on the pruning rows, and its precision there."""
    best, worth, precision = rule, -2.0, 0.0
    for k in range(len(rule), 0, -1):
        hit = _covered(rule[:k], x, len(bad))
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        if p + n and (v := (p - n) / (p + n)) >= worth:
            best, worth, precision = rule[:k], v, p / (p + n)
    return best, precision


def learn(rows: list[tuple[int, dict[str, float | None]]]) -> list[Rule]:
    """Rules that reject label 0, from (label, statistics) in a fixed order; a missing statistic is 0."""
    bad = np.array([label == 0 for label, _ in rows], bool)
    x = {s: np.array([float(r[s] or 0) for _, r in rows]) for s in RATIOS}
    turn = np.arange(len(rows)) % 3
    left, rules = np.ones(len(rows), bool), []
    while bad[left].any() and not bad[left].all():
        grow, prune = left & (turn != 2), left & (turn == 2)
        rule = _grow({s: v[grow] for s, v in x.items()}, bad[grow]) if bad[grow].any() else ()
        if not rule:
            break
        rule, precision = _prune(rule, {s: v[prune] for s, v in x.items()}, bad[prune])
        if precision < PRECISION:
            break
        rules.append(rule)
        left &= ~_covered(rule, x, len(rows))
    return rules


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, text and quality of at most `most` labelled documents, chosen by hash; no row whose crc32(doc_id) mod 5 is 0.

    Of a doc_id with several texts that with the smallest hash is taken. The labels' side is bounded by `most` rows and is therefore broadcast.
    """
    chosen = labels.where("doc_id is not null and quality in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select("doc_id", body.alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("digest"), "text")).alias("one")).select("doc_id", "one.text", "quality")


def learned(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[Rule]:
    stats = with_statistics(labelled_sample(documents, labels, most))
    ratios = [F.try_divide(*(F.col(c) for c in e.split(" / "))).alias(s) for s, e in RATIOS.items()]
    rows = stats.select("doc_id", "quality", base_failed().alias("base_failed"), *ratios).collect()
    rows = sorted((r for r in rows if not r["base_failed"]), key=lambda r: (r["doc_id"], *(r[s] or 0 for s in RATIOS)))
    return learn([(r["quality"], r.asDict()) for r in rows])


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression of a list: false where a rule holds, else true."""
    out = None
    for rule in rules:
        cond = rule[0].column()
        for c in rule[1:]:
            cond = cond & c.column()
        out = F.when(cond, False) if out is None else out.when(cond, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judged(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """df with the statistics, base_failed and kept, which replace columns of these names."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    rows = with_statistics(df.select(row, F.col(text).alias("_body")), "_body").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    new = [c for c in rows.columns if c not in ("_row", "_body")]
    return rows.select(*(F.col(f"_row.`{c}`").alias(c) for c in df.columns if c not in new), *new)


def kept_only(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of df that the list keeps, with the columns of df."""
    keep = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    rows = judged(df.select(keep, F.col(text).alias("_body")), rules, "_body")
    return rows.where("kept").select("_row.*")
