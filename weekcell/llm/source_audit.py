"""Audit of how far the sources of a language diverge in their words, by chunk factorization.

A chunk is a run of other bytes than ASCII white space (``[^\\x20\\x09-\\x0D]+``); a term is a run of ASCII letters and characters beyond ASCII,
A-Z in lower case, so a term never crosses two chunks. Documents are only split into chunks. Each distinct chunk of a language is cut into terms once,
beside its number of documents, which decides which terms are kept; kept terms are then joined to the chunk's occurrences by source.

Terms are kept where a language has them in ``least`` documents or more. Chunks count their documents exactly, so a term has between
the most of one chunk and the sum of all its chunks. Where that leaves the question open, the documents with these chunks are looked up in the
texts and distinct ones are counted. A row is a document, also where doc_id repeats or is null.

Source profiles are compared in tiles of sources and blocks of terms, as matrices of bounded size: nothing is emitted for a pair of sources
and a term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekcell.llm import bitmaps
from weekcell.llm.components import written
from weekcell.llm.registry import query, table
from weekcell.llm.splitting import word_lists
from weekcell.llm.words import text_chunks

#: Documents that must hold a term.
LEAST_DOCUMENTS = 10
#: A term, in the syntax of java.util.regex.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Characters of a chunk up to which equal terms are counted where the chunk lies; the terms of a longer chunk are dealt out for that.
SHORT_CHUNK = 64
#: Different chunks that a task counts before it sends them on, for which a piece of text has TEXT_BYTES bytes each, and rows in one batch.
HELD_CHUNKS = 400_000
TEXT_BYTES = 40
BATCH_ROWS = 50_000
#: Bits of the filters of chunks (4 MB); a full one costs time, not results.
FILTER_BITS = 1 << 25
#: Sources in a tile and terms in a block: the sides of the matrices that are compared.
TILE_SOURCES = 256
BLOCK_TERMS = 8192

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(column: pa.Array, low: int, high: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct chunks of the texts in rows low..high, and (place of the chunk, row, times) for each chunk of a row.

    Arrow parts at exactly the six characters. A text that is a piece of its own is split in parts; its distinct chunks are held.
    """
    if high - low == 1 and column.slice(low, 1).nbytes > HELD_CHUNKS * TEXT_BYTES:
        own: Counter = Counter()
        for words in word_lists(column[low].as_py()):
            own.update(words)
        chunks = pa.array(list(own), pa.binary()).cast(pa.string())
        return chunks, np.arange(len(own)), np.full(len(own), low), np.fromiter(own.values(), np.int64, len(own))
    lists = pc.ascii_split_whitespace(column.slice(low, high - low))
    coded = lists.flatten().dictionary_encode()
    chunks, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(low, high), lists.value_lengths().to_numpy())
    blank = pc.index(chunks, "").as_py()  # before a white space that opens a text, and after one that ends it
    if blank >= 0:
        row, code = row[code != blank], code[code != blank]
    size = max(1, len(chunks))
    key, times = np.unique(row * size + code, return_counts=True)
    return chunks, key % size, key // size, times


def _batches(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    """Columns as batches of BATCH_ROWS rows."""
    yield from pa.table(columns).to_batches(max_chunksize=BATCH_ROWS)


def _documents_of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, lang, docs): in how many documents of the language each chunk stands, summed over a piece of a batch."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        lang = langs.indices.to_numpy()
        for low, high in text_chunks(batch.column("text"), HELD_CHUNKS * TEXT_BYTES):
            chunks, code, row, _ = _split(batch.column("text"), low, high)
            size = max(1, len(chunks))
            key, docs = np.unique(lang[row] * np.int64(size) + code, return_counts=True)
            yield from _batches({"chunk": chunks.take(pa.array(key % size)), "lang": langs.dictionary.take(pa.array(key // size)), "docs": pa.array(docs, pa.int64())})


def _prepared(docs: DataFrame) -> DataFrame:
    """text, lang and source as strings; nulls are empty. Other columns are left behind, whatever their names."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def terms_of(chunk: Column) -> Column:
    """The terms of a chunk in order."""
    return F.regexp_extract_all(F.translate(chunk, UPPER, LOWER), F.lit(TERM), F.lit(0))


def factorized(docs: DataFrame) -> DataFrame:
    """(lang, chunk, term, times, docs) as a written table: the documents of a language that hold the chunk, and how often the chunk holds the term."""
    counted = _prepared(docs).select("text", "lang").mapInArrow(_documents_of_chunks, "chunk string, lang string, docs long")
    chunks = written(counted.groupBy("chunk", "lang").agg(F.sum("docs").alias("docs")), "chunks", compression="zstd")
    cut = chunks.withColumn("terms", terms_of(F.col("chunk")))
    short, long = cut.filter(F.length("chunk") <= SHORT_CHUNK), cut.filter(F.length("chunk") > SHORT_CHUNK)
    times = F.size(F.filter("terms", lambda t: t == F.col("term"))).cast("long").alias("times")
    here = short.withColumn("term", F.explode(F.array_distinct("terms"))).select("lang", "chunk", "term", times, "docs")
    dealt = (long.select("lang", "chunk", "docs", F.explode("terms").alias("term"))
             .groupBy("lang", "chunk", "term").agg(F.count(F.lit(1)).alias("times"), F.first("docs").alias("docs")))
    return written(here.unionByName(dealt), "factors", compression="zstd")


def _second_look(wanted, doubtful):
    """(chunk, lang, sources, n, row) of the chunks that the filter ``wanted`` lets pass: a piece's sources and occurrences in each, with null row; and of those
    that ``doubtful`` lets pass a row for each document that holds them, with null sources and n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = wanted.value, doubtful.value
        for batch in batches:
            langs, sources = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
            lang, source = langs.indices.to_numpy(), sources.indices.to_numpy()
            width = max(1, len(sources.dictionary))
            for low, high in text_chunks(batch.column("text"), HELD_CHUNKS * TEXT_BYTES):
                chunks, code, row, times = _split(batch.column("text"), low, high)
                slots = np.fromiter((xxhash.xxh64_intdigest(c, 42) % FILTER_BITS for c in chunks.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.int64, len(chunks))
                kept, open_ = bitmaps.holds(first, slots)[code], bitmaps.holds(second, slots)[code]
                size = max(1, len(chunks))
                key, n = _sums((lang[row[kept]] * np.int64(size) + code[kept]) * width + source[row[kept]], times[kept])
                of = key // width
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                ends, of = pa.array(np.append(starts, len(key)), pa.int32()), of[starts]
                yield from _batches({"chunk": chunks.take(pa.array(of % size)), "lang": langs.dictionary.take(pa.array(of // size)),
                                     "sources": pa.ListArray.from_arrays(ends, sources.dictionary.take(pa.array(key % width))),
                                     "n": pa.ListArray.from_arrays(ends, pa.array(n, pa.int64())), "row": pa.nulls(len(of), pa.int64())})
                at = pa.array(row[open_])
                yield from _batches({"chunk": chunks.take(pa.array(code[open_])), "lang": batch.column("lang").take(at), "sources": pa.nulls(len(at), pa.list_(pa.string())),
                                     "n": pa.nulls(len(at), pa.list_(pa.int64())), "row": batch.column("row").take(at)})
    return run


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``n`` over each."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def kept_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(lang, term) of the terms that stand in ``least`` documents of the language, and (lang, source, term, n) of their occurrences; both written.

    The filters have a fixed size and pass through the driver; they only spare rows, the joins decide.
    """
    spark = docs.sparkSession
    factors = factorized(docs)
    bounds = written(factors.groupBy("lang", "term").agg(F.sum("docs").alias("most"), F.max("docs").alias("fewest")).filter(F.col("most") >= least), "bounds")
    wanted = written(factors.drop("docs").join(bounds.select("lang", "term", (F.col("fewest") < least).alias("open")), ["lang", "term"]), "wanted",
                     compression="zstd")

    def shared(chunks: DataFrame):
        slots = chunks.select(bitmaps.slot(F.col("chunk"), FILTER_BITS).alias("slot")).distinct()
        return spark.sparkContext.broadcast(bitmaps.build(slots, FILTER_BITS))

    rows = _prepared(docs).withColumn("row", F.monotonically_increasing_id())
    look = written(rows.mapInArrow(_second_look(shared(wanted), shared(wanted.filter("open"))), "chunk string, lang string, sources array<string>, n array<bigint>, row long"),
                   "look", compression="zstd")
    found = (look.filter(F.col("row").isNotNull()).join(wanted.filter("open"), ["lang", "chunk"]).select("lang", "term", "row").distinct()
             .groupBy("lang", "term").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= least))
    kept = written(bounds.filter(F.col("fewest") >= least).select("lang", "term").union(found.select("lang", "term")), "kept")
    # occurrences meet a hash table of their chunks' factors as they come, a row for each chunk of a piece of text, neither summed nor sorted before
    here = wanted.join(kept, ["lang", "term"]).select("lang", "chunk", "term", "times").hint("shuffle_hash")
    held = look.filter(F.col("row").isNull()).select("lang", "chunk", "sources", "n").join(here, ["lang", "chunk"])
    counts = (held.select("lang", "term", "times", "n", F.posexplode("sources").alias("at", "source")).groupBy("lang", "source", "term")
              .agg(F.sum(F.col("n")[F.col("at")] * F.col("times")).alias("n")))
    return kept, written(counts, "counts")


def _p(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (n + 2) / (total + 2 * terms)), in decimals so that no count overflows; null without terms."""
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (n.cast("decimal(19,0)") + F.lit(2))
    below = total.cast("decimal(19,0)") + F.lit(2) * terms.cast("decimal(18,0)")
    return F.when(terms > 0, F.lit(1) + F.call_function("div", top, below)).cast("long")


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def profiles(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts (lang, source, term, n, p) of kept terms that occur, levels (lang, source, terms, total, zero) of every group, ``zero`` being the p
    of a count of 0, and the languages' (lang, term, q). Counts and levels are written tables."""
    kept, counts = kept_counts(docs, least)
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    groups = (_prepared(docs).select("lang", "source").distinct().join(terms, "lang", "left")
              .join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
              .select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total")))
    levels = written(groups.withColumn("zero", _p(F.lit(0), F.col("total"), F.col("terms"))), "levels")
    with_p = counts.join(levels, ["lang", "source"]).select("lang", "source", "term", "n", _p(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    whole = levels.groupBy("lang").agg(F.max("terms").alias("terms"), F.sum("total").alias("total"))
    base = (counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(whole, "lang")
            .select("lang", "term", _p(F.col("n"), F.col("total"), F.col("terms")).alias("q")))
    return with_p, levels, base


def _compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of f over the block's terms for the pairs of sources of two tiles, both ways."""
    lang, _, one, two = (k.as_py() if hasattr(k, "as_py") else k for k in key)
    zeros = rows[rows["term"].isna()].sort_values("source")
    names, tiles, zero = zeros["source"].to_numpy(object), zeros["tile"].to_numpy(), zeros["p"].to_numpy(np.int64)
    counted = rows[rows["term"].notna()]
    column, terms = pd.factorize(counted["term"])
    level = np.repeat(zero[:, None], len(terms), axis=1)
    level[pd.Index(names).get_indexer(counted["source"]), column] = counted["p"].to_numpy(np.int64)
    left, right = np.flatnonzero(tiles == one), np.flatnonzero(tiles == two)
    a, b, value = [], [], []
    for i in left:
        others = right[right > i] if one == two else right
        gap = level[others] - level[i]
        value.append((gap * gap // (level[others] + level[i])).sum(axis=1))
        a.append(np.full(len(others), i))
        b.append(others)
    a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
    value = np.concatenate(value) if value else np.zeros(0, np.int64)
    return pd.DataFrame({"lang": lang, "source": names[np.concatenate([a, b])], "item": names[np.concatenate([b, a])],
                         "value": np.concatenate([value, value]), "seen": len(terms)})


def source_pairs(counts: DataFrame, levels: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each other source of the language: sum over all kept terms of floor((p - q)**2 / (p + q)).

    Terms that neither source has add the same each, so they are counted. The driver gets the two largest numbers of terms and sources of a language.
    """
    most = levels.groupBy("lang").agg(F.max("terms").alias("terms"), F.count(F.lit(1)).alias("sources")).agg(F.max("terms"), F.max("sources")).first()
    blocks, tiles = max(1, -(-(most[0] or 0) // BLOCK_TERMS)), max(1, -(-(most[1] or 0) // TILE_SOURCES))
    tile = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int").alias("tile")
    held = counts.select("lang", "source", "term", "p", tile, F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"))
    empty = levels.select("lang", "source", F.lit(None).cast("string").alias("term"), F.coalesce("zero", F.lit(0)).cast("long").alias("p"), tile,
                          F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dealt = (held.unionByName(empty).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
             .withColumns({"one": F.least("tile", "other"), "two": F.greatest("tile", "other")}))
    sums = (dealt.groupBy("lang", "block", "one", "two").applyInPandas(_compare, "lang string, source string, item string, value long, seen long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")))
    own = levels.select("lang", "source", "terms", "zero")
    other = levels.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"))
    unseen = (F.col("terms") - F.col("seen")) * _f(F.col("zero"), F.col("item_zero"))
    return (sums.join(own, ["lang", "source"]).join(other, ["lang", "item"])
            .select("lang", "source", "item", (F.col("value") + F.coalesce(unseen, F.lit(0))).alias("value")))


def marked_terms(counts: DataFrame, base: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms that a source has more of than its language, and by how much."""
    return (counts.join(base, ["lang", "term"]).filter(F.col("p") > F.col("q"))
            .select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value")))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of a language by their distance, part ``term`` the ``top`` terms that
    stand out. Null text, lang and source are empty strings. Ties go to the smaller item in UTF-8 order.

    An empty table gives no rows. A language with one source has no pairs; one without kept terms has pairs of value 0 and no terms.
    """
    counts, levels, base = profiles(docs, least)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_pairs(counts, levels).withColumn("rank", F.row_number().over(best))
    terms = marked_terms(counts, base).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).union(terms.withColumn("part", F.lit("term")).select(columns))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (
    SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
grp AS (SELECT DISTINCT lang, source FROM d),
had AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
cnt AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n FROM grp g JOIN kept k USING (lang) LEFT JOIN had h USING (lang, source, term)),
p AS (
    SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER g + 2 * count(*) OVER g) AS p
    FROM cnt WINDOW g AS (PARTITION BY lang, source)),
q AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER g + 2 * count(*) OVER g) AS q
    FROM (SELECT lang, term, sum(n) AS n FROM cnt GROUP BY ALL) WINDOW g AS (PARTITION BY lang)),
summed AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query("op12_source_audit", OP12_SQL)
def op12_source_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit(table(spark, folder, "documents"))
