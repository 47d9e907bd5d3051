"""License scans by an exact set-similarity join of text blocks with license templates, in DataFrame expressions only.

A word is a run of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case. A text is read in blocks of 2W words that start W
words apart, W being the longest template, so every stretch of a template's length lies whole in one block. A block meets a template
when it holds ``percent`` % of the template's different words or more.

The join is PPJoin's, for containment. The templates' words are ordered by their frequency in the corpus, rarest first. A template of n words of
which r are required keeps its n - r + 1 rarest as prefix: a block without any of these can't hold r words. Blocks that have prefix words are
joined with the prefixes by word; pairs are dropped where the block holds fewer than r template words (length filter) or where the places
of the first common word in both orders leave fewer than r (positional filter), and the others are counted exactly.

Two passes over the texts: frequencies of template words, then counts, places of phrases and candidate blocks, which are written.
The templates are a parameter of a bounded size (MAX_TOKENS different words); their words, frequencies and prefixes pass through the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcell.llm.components import written
from weekcell.llm.quality import let
from weekcell.llm.registry import query, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's words that a block must hold, in percent.
PERCENT = 90
#: Different words of all templates together; more raise an error.
MAX_TOKENS = 10_000

#: Phrases of the contract and their labels.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Opening sentences or notices of public licenses.
TEMPLATES = [
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


@dataclass(frozen=True)
class Template:
    label: str
    tokens: tuple[str, ...]
    required: int


def plain_words(text: str) -> list[str]:
    """The words of a template or phrase."""
    return [w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if w]


def templates_of(texts: list[tuple[str, str]], percent: int) -> list[Template]:
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and at most 100")
    out = []
    for label, text in texts:
        tokens = tuple(dict.fromkeys(plain_words(text)))
        if tokens:
            out.append(Template(label, tokens, -(-percent * len(tokens) // 100)))
    if len({t for x in out for t in x.tokens}) > MAX_TOKENS:
        raise ValueError(f"templates have more than {MAX_TOKENS} different words")
    return out


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BETWEEN), "")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def frequency_order(docs: DataFrame, templates: list[Template]) -> list[str]:
    """The templates' words, rarest in ``docs`` first (number of documents, then the word itself)."""
    tokens = sorted({t for x in templates for t in x.tokens})
    if not tokens:
        return []
    found = (docs.select(F.explode(F.array_intersect(words_of(F.col("text")), _strings(tokens))).alias("token"))
             .groupBy("token").agg(F.count(F.lit(1)).alias("docs")).collect())
    docs_of = {r.token: r.docs for r in found}
    return sorted(tokens, key=lambda t: (docs_of.get(t, 0), t))


def _places(words: Column, phrase: list[str]) -> Column:
    """Where the phrase stands; texts that lack one of its words are not looked through."""
    def starts(w: Column) -> Column:
        def at(word: Column, i: Column) -> Column:
            same = word == phrase[0]
            for k in range(1, len(phrase)):
                same = same & (F.get(w, i + k) == phrase[k])
            return F.when(same, i.cast("long"))
        return F.filter(F.transform(w, at), lambda x: x.isNotNull())
    held = F.array_contains(words, phrase[0])
    for p in phrase[1:]:
        held = held & F.array_contains(words, p)
    return F.when(held, let(words, starts)).otherwise(F.array().cast("array<bigint>"))


def _named(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(label).alias("label")))


def _blocks(words: Column, width: int, prefix: list[str]) -> Column:
    """Blocks (start, tokens) of 2 ``width`` words that hold a prefix word."""
    wanted = _strings(prefix)

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - width - 1), F.lit(width))
        return F.filter(F.transform(starts, lambda s: F.struct(s.cast("long").alias("start"), F.array_distinct(F.slice(w, s + 1, 2 * width)).alias("tokens"))),
                        lambda b: F.arrays_overlap(b["tokens"], wanted))
    return F.when(F.arrays_overlap(words, wanted), let(words, cut)).otherwise(F.array().cast("array<struct<start:bigint,tokens:array<string>>>"))


def _rows(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A small table from literals, without Python workers. ``rows`` must not be empty."""
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(*[(_strings(list(v)) if isinstance(v, tuple) else F.lit(v)).alias(c) for c, v in zip(columns, r)]) for r in rows])))


def contained(blocks: DataFrame, templates: list[Template], order: list[str]) -> DataFrame:
    """(rid, start, template, found) for every block (rid, start, tokens) and template that meet; ``template`` is a place in ``templates``."""
    spark, place = blocks.sparkSession, {t: k for k, t in enumerate(order)}
    index, sets = [], []
    for k, x in enumerate(templates):
        ranked = sorted(x.tokens, key=place.__getitem__)
        sets.append((k, tuple(ranked), len(ranked), x.required))
        index += [(t, k, i) for i, t in enumerate(ranked[:len(ranked) - x.required + 1])]
    known = _rows(spark, ["template", "wanted", "size", "required"], sets)
    prefixes = _rows(spark, ["token", "template", "i"], index)
    held = blocks.select("rid", "start", F.array_intersect(_strings(order), "tokens").alias("held"))  # in the global order
    pairs = (held.select("rid", "start", "held", F.posexplode("held").alias("j", "token")).join(prefixes, "token")
             .groupBy("rid", "start", "template").agg(F.min("i").alias("i"), F.min("j").alias("j"), F.any_value("held").alias("held"))
             .join(known, "template"))
    left = F.lit(1) + F.least(F.col("size") - F.col("i") - 1, F.size("held") - F.col("j") - 1)
    return (pairs.filter((F.size("held") >= F.col("required")) & (left >= F.col("required")))
            .withColumn("found", F.size(F.array_intersect("wanted", "held"))).filter(F.col("found") >= F.col("required"))
            .select("rid", "start", "template", "found"))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), texts: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES,
         percent: int = PERCENT) -> DataFrame:
    """(row, n_words, places, matches) for each row of ``docs``.

    ``row`` holds the columns ``keep`` as a struct, so none of them can clash. ``places`` are (start, label) of the phrases, ``matches`` (label, start, found,
    size) of each template that a block meets: the block's first word, and how many of the template's ``size`` words it holds. A null text is empty, and
    an empty one has no words, places and matches; repeated rows each give a row; an empty table gives none. No texts of templates, or none with
    words, give no matches. The longest text tested is 12 MB.
    """
    spark = docs.sparkSession
    templates = templates_of(texts, percent)
    order = frequency_order(docs, templates)
    place = {t: k for k, t in enumerate(order)}
    prefix = sorted({t for x in templates for t in sorted(x.tokens, key=place.__getitem__)[:len(x.tokens) - x.required + 1]}, key=place.get)
    width = max([len(plain_words(text)) for _, text in texts], default=1)
    found = [_named(_places(F.col("words"), plain_words(p)), label) for label, p in phrases if plain_words(p)]
    based = written(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.monotonically_increasing_id().alias("rid"), words_of(F.col("text")).alias("words"))
        .select("row", "rid", F.size("words").cast("long").alias("n_words"), F.flatten(F.array(*found)).alias("places") if found else
                F.array().cast("array<struct<start:bigint,label:string>>").alias("places"), _blocks(F.col("words"), width, prefix).alias("blocks")),
        "license-base", compression="zstd")
    if not templates:
        return based.select("row", "n_words", "places", F.array().cast("array<struct<label:string,start:bigint,found:int,size:int>>").alias("matches"))
    names = _rows(spark, ["template", "label", "size"], [(k, x.label, len(x.tokens)) for k, x in enumerate(templates)])
    met = (contained(based.select("rid", F.inline("blocks")), templates, order).join(names, "template")
           .groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("label", "start", "found", "size"))).alias("matches")))
    none = F.array().cast(met.schema["matches"].dataType)
    return based.drop("blocks").join(met, "rid", "left").select("row", "n_words", "places", F.coalesce("matches", none).alias("matches"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from ``scan``: a phrase scores 1, a template the share of its words that the best block holds."""
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    listed = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["found"].cast("double") / m["size"])), F.lit(0.0))
    return found.select(
        F.col("row")["doc_id"].alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), listed(base).alias("base_labels"),
        listed(F.concat(base, F.transform("matches", lambda m: m["label"]))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_WIDTH = max(len(plain_words(text)) for _, text in TEMPLATES)
OP13_SQL = f"""
WITH split AS (
    SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'),
        lambda x: x <> '') AS w FROM documents),
phrases(label, p) AS (VALUES {', '.join(f"('{label}', {_sql_list(plain_words(p))})" for label, p in PHRASES)}),
templates(label, t) AS (VALUES {', '.join(f"('{label}', {_sql_list(list(dict.fromkeys(plain_words(t))))})" for label, t in TEMPLATES)}),
places AS (
    SELECT rid, label, i AS start FROM (SELECT rid, w, unnest(range(0, len(w))) AS i FROM split) s, phrases
    WHERE w[i + 1] = p[1] AND w[i + 1:i + len(p)] = p),
blocks AS (SELECT rid, list_distinct(w[s + 1:s + {2 * _WIDTH}]) AS b FROM (SELECT rid, w, unnest(range(0, greatest(1, len(w) - {_WIDTH}), {_WIDTH})) AS s FROM split)),
met AS (
    SELECT rid, label, max(len(list_intersect(t, b))::DOUBLE / len(t)) AS held FROM blocks, templates
    WHERE 100 * len(list_intersect(t, b)) >= {PERCENT} * len(t) GROUP BY rid, label),
base AS (SELECT rid, count(*) AS n, min(start) AS low, max(start) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY rid),
both_ AS (
    SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(held) AS best
    FROM (SELECT rid, label, 1.0::DOUBLE AS held FROM places UNION ALL SELECT rid, label, held FROM met) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.low::BIGINT AS first_word, b.high::BIGINT AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, coalesce(a.best, 0.0)::DOUBLE AS score
FROM split LEFT JOIN base b USING (rid) LEFT JOIN both_ a USING (rid)
"""


@query("op13_licenses", OP13_SQL)
def op13_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return digest(scan(table(spark, folder, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))))
