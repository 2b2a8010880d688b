"""License scans: a positional index of rare licence words, in native expressions.

Texts become words, A-Z in lower case. Beside phrases that are counted wherever their words stand in a row (the base), texts of licences are found:

1. In how many documents each word of the templates occurs is counted over all documents. The index holds, for each template, the places of its RARE
   words that fewest documents have (highest IDF).
2. Of each document the places of words that the index holds are looked up. Each names, with a posting of the word, a template and where in the document it
   would begin. Places that agree on both are votes; at least half of a template's postings must agree.
3. Where they do, each key phrase of the template must stand in the document, at most SLACK words from where it should.

Labels of templates that pass join those of the base phrases. The score is 1 with a base phrase, else the largest share of a template's words that stand
where they should. Nothing is capped: any verbatim copy of a template has all its postings, and all its alignments are tried.

Counting words is an aggregate of as many rows as the templates have words; all else is a map over the documents without a shuffle. Templates are
parameters, so what goes to the tasks does not grow with the data.

Defined cases: a null text has no words; no words give no labels and score 0; rows are judged one by one, repeated ones and those with a null doc_id too;
of words that equally many documents have the smaller one is rarer; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a template in the index at least (all places of each), and words that a key phrase may stand away from its place.
RARE, SLACK = 4, 8

#: Phrases of the base and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def places(self) -> list[tuple[int, int, str]]:
        """Place, length in words and text of each key phrase."""
        out = []
        for key in self.keys:
            w = key.split()
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(w)] == w)
            out.append((at, len(w), key))
        return out


#: Notices of public licences as words.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    Template("apache", "licensed under the apache license version", ("apache license version",)),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    Template("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright", "neighboring rights")),
    Template("gnu-gpl", "licensed under the gnu general public license version", ("gnu general public license",)),
    Template("gnu-gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("terms of the gnu general public license", "free software foundation")),
    Template("gnu-lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("terms of the gnu lesser general public license", "free software foundation")),
    Template("gnu-agpl", "redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("terms of the gnu affero general public license", "free software foundation")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
)


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """df with _words, the words of each whole text."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # lower() also changes letters beyond ASCII, so it takes texts of ASCII only; there it is much faster
    small = F.when(F.octet_length(body) == F.char_length(body), F.lower(body)).otherwise(F.translate(body, CAPITALS, SMALL))
    spaced = F.btrim(F.regexp_replace(small, GAP, " "))
    return df.withColumn("_spaced", spaced).withColumn("_words", F.when(F.col("_spaced") == "", F.array().cast("array<string>")).otherwise(F.split("_spaced", " ", -1)))


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def frequencies(documents: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """How many documents have each word of the templates: as many rows as these have words."""
    rows = with_words(documents.select(F.col(text).alias("text")), "text")
    there = rows.select(F.explode(F.array_intersect("_words", F.lit(vocabulary(templates)))).alias("word"))
    found = {r["word"]: r["n"] for r in there.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: found.get(w, 0) for w in vocabulary(templates)}


def index(df: dict[str, int], templates: tuple[Template, ...] = TEMPLATES, rare: int = RARE) -> dict[str, list[tuple[int, int]]]:
    """(template, place) of each indexed word, rarest words first."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(templates):
        few = set(sorted(set(template.words), key=lambda w: (df[w], w))[:rare])
        for at, w in enumerate(template.words):
            if w in few:
                out.setdefault(w, []).append((t, at))
    return dict(sorted(out.items(), key=lambda x: (df[x[0]], x[0])))


def needed(found: dict[str, list[tuple[int, int]]], n: int) -> list[int]:
    """Votes that each template needs: half of its postings."""
    return [-(-sum(t == p for ps in found.values() for p, _ in ps) // 2) for t in range(n)]


def places(words: str, phrases: list[str]) -> Column:
    """(start, phrase number) of each place where the words of a phrase stand in a row."""
    def of(n: int, phrase: str) -> Column:
        first, *rest = phrase.split()

        def here(w: Column, i: Column) -> Column:
            ok = w == first
            for k, x in enumerate(rest, 1):
                ok = ok & F.coalesce(F.get(F.col(words), i + k) == x, F.lit(False))
            return F.when(ok, F.struct(i.alias("i"), F.lit(n).alias("n")))

        return F.filter(F.transform(words, here), lambda s: s.isNotNull())

    return F.concat(*(of(n, p) for n, p in enumerate(phrases)))


def alignments(words: str, found: dict[str, list[tuple[int, int]]], templates: tuple[Template, ...], slack: int = SLACK) -> Column:
    """(t, o): templates that pass, with the place where they would begin in the document."""
    rare = list(found)
    postings = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in found[w]]) for w in rare])
    keys = F.array(*[F.array(*[F.struct(F.lit(at).alias("at"), F.lit(n).alias("n"), F.lit(f" {key} ").alias("key")) for at, n, key in t.places()]) for t in templates])
    need = F.lit(needed(found, len(templates)))
    hits = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), F.array_position(F.lit(rare), w).cast("int").alias("k"))), lambda s: s["k"] > 0)
    votes = F.array_sort(F.flatten(F.transform(hits, lambda h: F.transform(F.get(postings, h["k"] - 1), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["p"]).alias("o"))))))
    # equal votes stand together: the first of a run that is long enough
    enough = lambda v: F.filter(F.transform(v, lambda x, j: F.when(F.coalesce(F.get(v, j - 1) != x, F.lit(True)) & F.coalesce(F.get(v, j + F.get(need, x["t"]) - 1) == x, F.lit(False)), x)), lambda x: x.isNotNull())

    def stands(c: Column, key: Column) -> Column:
        first = c["o"] + key["at"] - slack
        around = F.slice(F.col(words), F.greatest(F.lit(1), first + 1), F.greatest(F.lit(0), key["n"] + 2 * slack + F.least(F.lit(0), first)))
        return F.contains(F.concat(F.lit(" "), F.array_join(around, " "), F.lit(" ")), key["key"])

    # votes are used several times: an argument of transform() is taken once
    one = F.flatten(F.transform(F.array(votes), enough))
    return F.filter(one, lambda c: F.forall(F.get(keys, c["t"]), lambda key: stands(c, key)))


def coverage(words: str, c: Column, templates: tuple[Template, ...]) -> Column:
    """The share of the words of template c.t that stand where they should from c.o on."""
    texts = F.array(*[F.lit(t.words) for t in templates])
    same = F.filter(F.transform(F.get(texts, c["t"]), lambda w, i: F.coalesce(F.get(F.col(words), c["o"] + i) == w, F.lit(False))), lambda ok: ok)
    return F.size(same) / F.size(F.get(texts, c["t"]))


def scanned(documents: DataFrame, found: dict[str, list[tuple[int, int]]], key: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels and score of each document."""
    phrases = list(PHRASES)
    rows = with_words(documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text")
    spaced = F.concat(F.lit(" "), F.col("_spaced"), F.lit(" "))
    some = F.contains(spaced, F.lit(f" {phrases[0]} "))
    for p in phrases[1:]:
        some = some | F.contains(spaced, F.lit(f" {p} "))
    none = F.array().cast("array<struct<i:int,n:int>>")
    rows = rows.withColumn("_base", F.when(some, places("_words", phrases)).otherwise(none))
    indexed = F.arrays_overlap("_words", F.lit(list(found)))
    rows = rows.withColumn("_aligned", F.when(indexed, alignments("_words", found, templates)).otherwise(F.array().cast("array<struct<t:int,o:int>>")))
    label_of, base_of = F.lit([t.label for t in templates]), F.lit(list(PHRASES.values()))
    base = F.transform("_base", lambda s: F.get(base_of, s["n"]))
    more = F.transform("_aligned", lambda c: F.get(label_of, c["t"]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts = F.transform("_base", lambda s: s["i"])
    share = F.array_max(F.transform("_aligned", lambda c: coverage("_words", c, templates)))
    return rows.select(
        F.col("_key").alias(key),
        F.size("_words").cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
    )


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """scanned() by the index of the documents' own frequencies."""
    return scanned(documents, index(frequencies(documents, text, templates), templates), key, text, templates)
