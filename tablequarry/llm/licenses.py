"""Licence scan over a positional rare-token index, with column expressions only.

The index holds, for each template word, its places in the templates. A file's words that are
template words are kept with their positions; the rarest words of a key phrase (by document
frequency over the whole corpus) give the places where a template may start, places on which the
two rarest agree stay, and the places of the other words of the mandatory key phrase are intersected
with them; at what is left the rest of the template is counted. All steps are passes over the hits
of a text, so work is in proportion to them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import let
from .common import stored, table

# The word rule, the base phrases and their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Licence texts (openings and notices), the key phrase in square brackets.
TEMPLATES = {
    "gpl-2.0": "licensed under the terms of the [gnu general public license version 2]",
    "gpl-3.0": "this work is licensed under the [gnu general public license version 3]",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the [gnu general public license as published by the free software foundation]",
    "lgpl": "under the terms of the [gnu lesser general public license] as published by the free software foundation",
    "agpl": "under the terms of the [gnu affero general public license] as published by the free software foundation",
    "apache-2.0": "licensed under the [apache license version 2 0]",
    "apache-notice": "[licensed under the apache license version 2 0 the license] you may not use this file except in compliance with the license",
    "cc-by-4.0": "licensed under [cc by 4 0]",
    "cc-by-sa-4.0": "licensed under [cc by sa 4 0]",
    "cc-by-nc-4.0": "licensed under [cc by nc 4 0]",
    "cc-by-nd-4.0": "licensed under [cc by nd 4 0]",
    "cc-by-nc-sa-4.0": "licensed under [cc by nc sa 4 0]",
    "cc-by-nc-nd-4.0": "licensed under [cc by nc nd 4 0]",
    "cc-by-name": "licensed under a [creative commons attribution 4 0 international license]",
    "mit-notice": "released under the [mit license]",
    "mit-grant": "[permission is hereby granted free of charge to any person obtaining a copy] of this software and associated documentation files",
    "bsd": "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met",
    "mpl-2.0": "this source code form is subject to the terms of the [mozilla public license v 2 0]",
    "isc": "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted",
    "unlicense": "this is [free and unencumbered software released into the public domain]",
    "bsl-1.0": "distributed under the [boost software license version 1 0]",
    "epl-2.0": "made available under the terms of the [eclipse public license 2 0]",
}
#: A template counts where its key phrase stands and so much of its words are at their places.
LEAST_SHARE = 0.6


@dataclass(frozen=True)
class Entry:
    """A template: its words, and where the key phrase starts and ends."""

    label: str
    words: tuple[str, ...]
    key: tuple[int, int]
    base: bool


def entries() -> list[Entry]:
    out = [Entry(label, tuple(p.split()), (0, len(p.split())), True) for p, label in BASE.items()]
    for label, text in TEMPLATES.items():
        before, _, rest = text.partition("[")
        phrase, _, after = rest.partition("]")
        words = [*before.split(), *phrase.split(), *after.split()]
        out.append(Entry(label, tuple(words), (len(before.split()), len(before.split()) + len(phrase.split())), False))
    return out


def vocabulary() -> list[str]:
    return sorted({w for e in entries() for w in e.words})


def _places(text: Column) -> Column:
    """Word count, and position * vocabulary size + word number of every template word, in order."""
    vocab = vocabulary()
    code = F.create_map(*[x for k, w in enumerate(vocab) for x in (F.lit(w), F.lit(k))])
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))

    def pick(b):
        marked = F.transform(b["w"], lambda w, i: F.when(w.isin(*vocab), i.cast("long") * len(vocab) + F.element_at(code, w)))
        return F.struct(F.size(b["w"]).cast("long").alias("n_words"), F.array_compact(marked).alias("hits"))

    return let(pick, w=found)


def postings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of the files: ``id_col, n_words, hits``; one row in, one row out."""
    return df.select(F.col(id_col), _places(F.col(text_col)).alias("__p")).select(id_col, "__p.n_words", "__p.hits")


def rarity(files: DataFrame) -> dict[str, float]:
    """IDF of every template word over all files; at most one row per template word reaches the driver."""
    vocab = vocabulary()
    words = F.explode(F.array_distinct(F.transform("hits", lambda h: F.pmod(h, F.lit(len(vocab))))))
    rows = files.select(words.alias("word")).groupBy("word").count().collect()
    total = files.count()
    seen = {vocab[r["word"]]: r["count"] for r in rows}
    return {w: math.log((1 + total) / (1 + seen.get(w, 0))) for w in vocab}


def _matches(hits: Column, idf: dict[str, float]) -> Column:
    """All places (template, start, share) where a key phrase stands."""
    vocab, every = vocabulary(), entries()
    size = len(vocab)
    number = {w: k for k, w in enumerate(vocab)}
    return F.concat(*[_template_places(t, e, hits, idf, size, number) for t, e in enumerate(every)])


def _template_places(t: int, e: Entry, hits: Column, idf: dict[str, float], size: int, number: dict[str, int]) -> Column:
    """The places of one template: the two rarest words of its key phrase agree, then its words are checked."""
    spots = sorted(range(*e.key), key=lambda j: (-idf[e.words[j]], j))
    rare = spots[:1] + [j for j in spots if e.words[j] != e.words[spots[0]]][:1]
    key = [j for j in range(*e.key) if j not in rare]
    rest = [j for j in range(len(e.words)) if not e.key[0] <= j < e.key[1]]

    def begins(j):
        own = F.filter(hits, lambda h: F.pmod(h, F.lit(size)) == number[e.words[j]])
        return F.transform(own, lambda h: F.floor(h / F.lit(size)).cast("long") - j)

    def agreed(starts):
        for j in [*rare[1:], *key]:
            starts = F.array_intersect(starts, begins(j))
        return let(lambda v: F.when(F.size(v["s"]) == 0, none).otherwise(_shares(v["s"], [begins(j) for j in rest], t, e)), s=starts)

    none = F.expr(_NO_PLACES)
    found = let(lambda v: F.when(F.size(v["s"]) == 0, none).otherwise(agreed(v["s"])), s=begins(rare[0]))  # most texts lack the rarest word
    return found if e.base else F.filter(found, lambda m: m["share"] >= LEAST_SHARE)


_NO_PLACES = "cast(array() as array<struct<t:int,at:bigint,share:double>>)"


def _shares(starts: Column, rest: list[Column], t: int, e: Entry) -> Column:
    """The places of a template with the share of its words, each other word of it counted at all starts in one go."""
    def counted(v):
        firsts = F.filter(F.sequence(F.lit(0), F.size(v["all"]) - 1), lambda i: (i == 0) | (F.get(v["all"], i) != F.get(v["all"], i - 1)))
        return let(lambda w: F.transform(w["first"], lambda i, k: place(v["all"], i, F.coalesce(F.get(w["first"], k + 1), F.size(v["all"])) - i - 1)), first=firsts)

    def place(every, i, n):
        share = (n + F.lit(e.key[1] - e.key[0])) / F.lit(len(e.words))
        return F.struct(F.lit(t).alias("t"), (F.get(every, i) + e.key[0]).alias("at"), share.alias("share"))

    return let(counted, all=F.array_sort(F.concat(F.array_distinct(starts), *[F.array_intersect(starts, begins) for begins in rest])))


def scan(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Licence places of every file of a stored positional index.

    Gives ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score``, one row for
    each row: the score is the largest share of a template found at its relative positions (1 for a
    whole template), 0 without any. A null or empty text has no words and no labels; repeated rows
    are scanned one by one; an empty table gives no rows.
    """
    every = entries()
    idf = rarity(files)
    names = F.array(*[F.lit(e.label) for e in every])
    n_base = sum(e.base for e in every)
    found = F.when(F.size("hits") > 1, _matches(F.col("hits"), idf)).otherwise(F.expr(_NO_PLACES))
    base = F.filter("__found", lambda m: m["t"] < n_base)

    def labels(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: F.get(names, m["t"])))), ",")

    return files.select(id_col, "n_words", found.alias("__found")).select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["at"])).alias("first_word"), F.array_max(F.transform(base, lambda m: m["at"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("__found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("__found", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


def query(spark, folder):
    """op9: licence places, labels and score of every document."""
    return scan(stored(postings(table(spark, folder, "documents"))))


def _sql() -> str:
    rows = ", ".join(f"({t}, '{e.label}', {j}, '{w}', {e.key[0] <= j < e.key[1]})" for t, e in enumerate(entries()) for j, w in enumerate(e.words))
    return rf"""
with word as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
place as (select doc_id, unnest(w) as word, unnest(range(len(w))) as pos from word),
template(t, label, j, word, key) as (values {rows}),
size as (select t, any_value(label) as label, count(*) as n, count(*) filter (where key) as keys, min(j) filter (where key) as key_at from template group by t),
met as (
  select doc_id, t, pos - j as start, count(*) as n, count(*) filter (where key) as keys
  from place join template using (word) group by all),
found as (
  select doc_id, t, label, start + key_at as spot, met.n / size.n as share
  from met join size using (t) where met.keys = size.keys and (t < {len(BASE)} or met.n / size.n >= {LEAST_SHARE})),
part as (
  select doc_id, count(*) filter (where t < {len(BASE)}) as n_base, min(spot) filter (where t < {len(BASE)}) as first_word, max(spot) filter (where t < {len(BASE)}) as last_word,
    string_agg(distinct label, ',' order by label) filter (where t < {len(BASE)}) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share) as score
  from found group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0) as score
from word left join part using (doc_id)"""


SQL = _sql()
