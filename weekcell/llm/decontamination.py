"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle set: class c holds sizes over 2**(c - 1) up to 2**c. For each
class, a document is read in blocks of 2**c shingles, so that an item meets something of its own size however long the document is, and each block gets
PERMUTATIONS minima. An item and a document that share a minimum in one block are candidates. A minimum of a block that holds no shingle of any
item is none of an item, so such blocks are left out first.

With containment t or more spread over any blocks, the Jaccard similarities of the blocks with the item add up to t / 3 at least
(the block is at most twice the item), so a candidate is missed with a chance below exp(-PERMUTATIONS * t / 3): 1e-6 for 52 and 0.8.
Candidates are verified by exact containment of the item's shingles in the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcell.llm import bitmaps
from weekcell.llm.components import written
from weekcell.llm.ngram_join import FILTER_BITS, fetch_sets, fingerprints, rows_without, set_rows
from weekcell.llm.registry import query, table
from weekcell.llm.words import distinct_by_row, mix, shingles, span_hashes, text_bytes, text_chunks, word_spans

PERMUTATIONS = 52
#: Bits of the filters of signatures and of the items' shingles (2 MB each for any number of test items).
SIGNATURE_BITS = 1 << 24
#: Odd factors of the permutations of 32-bit hashes.
_FACTORS = (mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(77)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)


def size_class(sizes: np.ndarray) -> np.ndarray:
    """0 for one shingle, c for 2**(c - 1) + 1 to 2**c."""
    return np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)


def _permutations(c: int) -> int:
    """A block of one shingle has one minimum, itself."""
    return 1 if c == 0 else PERMUTATIONS


def block_minima(values: np.ndarray, rows: np.ndarray, c: int, marked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row of each block, minima by permutation and block) of the shingles in rows[k]:rows[k + 1]; only of blocks with a shingle that is ``marked``, if given."""
    size = 1 << c
    blocks = -(-np.diff(rows) // size)
    owner = np.repeat(np.arange(len(blocks)), blocks)
    first = rows[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * size
    if marked is not None:
        upto = np.concatenate([[0], np.cumsum(marked)])
        held = upto[np.minimum(first + size, rows[1:][owner])] > upto[first]
        owner, first = owner[held], first[held]
    if not len(owner):
        return owner, np.zeros((_permutations(c), 0), dtype=np.uint32)
    # places beyond the row's end repeat the block's first shingle: that changes no minimum
    places = first[None, :] + np.arange(min(size, int(np.diff(rows).max())))[:, None]
    places = np.where(places < rows[1:][owner][None, :], places, first[None, :])
    short = (values >> np.uint64(32)).astype(np.uint32)[places]
    return owner, np.stack([(short * f).min(axis=0) for f in _FACTORS[:_permutations(c)]])


def _keys(minima: np.ndarray, c: int, k: int) -> np.ndarray:
    """64-bit keys of one permutation's minima."""
    return mix(minima.astype(np.uint64) + (np.uint64(c * PERMUTATIONS + k + 1) << np.uint64(32)))


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(40)).astype(np.int64)


def _items(n: int):
    """Per item: size, class, its shingles and the keys of its minima."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids = batch.column("text"), batch.column("item_id")
            for low, high in text_chunks(column):
                values, rows, _ = set_rows(column, low, high, n)
                sizes = np.diff(rows)
                classes = size_class(sizes)
                keys = []
                for r in range(high - low):
                    _, minima = block_minima(values[rows[r]:rows[r + 1]], np.array([0, sizes[r]]), int(classes[r]))
                    keys.append([int(x) for k in range(len(minima)) for x in _keys(minima[k], int(classes[r]), k).view(np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, high - low), pa.array(sizes), pa.array(classes.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(values.view(np.int64))), pa.array(keys, pa.list_(pa.int64()))],
                    ["item_id", "n_shingles", "class", "items", "keys"])
    return run


def _document_keys(n: int, classes: list[int], shared):
    """(key, fp, doc_id) of minima that the filter of the items' signatures lets pass, once for each document.

    Equal minima come from shingles of equal upper halves, so what the filter of the items' shingles (by their first bits) stops is in no candidate.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, held = shared.value
        for batch in batches:
            column, ids = batch.column("text"), batch.column("doc_id")
            for low, high in text_chunks(column):
                data, offsets = text_bytes(column, low, high)
                starts, lengths, word_rows = word_spans(data, offsets)
                values, rows = shingles(span_hashes(data, starts, lengths), word_rows, n)
                marked = bitmaps.holds(held, _slots(values))
                sizes = np.diff(rows)
                upto = np.concatenate([[0], np.cumsum(marked)])
                some = upto[rows[1:]] > upto[rows[:-1]]
                values, marked = values[np.repeat(some, sizes)], marked[np.repeat(some, sizes)]
                kept, rows = np.flatnonzero(some), np.concatenate([[0], np.cumsum(sizes[some])])
                fp = fingerprints(*distinct_by_row(values, rows))
                out_keys, out_rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for c in classes:
                    owner, minima = block_minima(values, rows, c, marked)
                    for k in range(len(minima)):
                        keys = _keys(minima[k], c, k)
                        hit = bitmaps.holds(bitmap, _slots(keys))
                        out_keys.append(keys[hit])
                        out_rows.append(owner[hit])
                keys, owner = np.concatenate(out_keys), np.concatenate(out_rows)
                order = np.lexsort((keys, owner))
                keys, owner = keys[order], owner[order]
                keep = np.ones(len(keys), dtype=bool)
                keep[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
                keys, owner = keys[keep], owner[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(fp[owner].view(np.int64)), ids.take(pa.array(low + kept[owner]))], ["key", "fp", "doc_id"])
    return run


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, fp, item_id, n_shingles, n_found) for every item of which a document holds ``percent`` % of the shingles or more.

    Words are runs of other bytes than ASCII white space, A-Z in lower case; an item or document of fewer than n words is one
    shingle, a null text or one without words has none and is never found. Rows that share a doc_id give their pairs once for each
    set of shingles. What reaches the driver: the list of size classes and a bitmap of fixed size.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = written(items.mapInArrow(_items(n), "item_id long, n_shingles long, class int, items array<bigint>, keys array<bigint>")
                    .filter("n_shingles > 0"), "items")
    classes = sorted(r["class"] for r in known.select("class").distinct().collect())
    signed = known.select("item_id", F.explode("keys").alias("key"))
    shingled = known.select(F.explode("items").alias("key"))
    shared = spark.sparkContext.broadcast(tuple(bitmaps.build(x.select(F.shiftrightunsigned("key", 40).alias("slot")), SIGNATURE_BITS) for x in (signed, shingled)))
    passed = written(docs.mapInArrow(_document_keys(n, classes, shared), "key long, fp long, doc_id long")
                     .join(signed, "key").select("fp", "doc_id", "item_id").distinct(), "passed")
    wanted = passed.select("fp").distinct()
    bits = bitmaps.build(passed.select(bitmaps.slot(F.col("doc_id"), FILTER_BITS).alias("slot")), FILTER_BITS)
    sets = (docs.withColumn("slot", bitmaps.slot(F.col("doc_id"), FILTER_BITS))
            .mapInArrow(fetch_sets(n, spark.sparkContext.broadcast(bits)), "fp long, items array<bigint>")
            .join(wanted, "fp", "left_semi").dropDuplicates(["fp"]))
    found = (passed.select("fp", "item_id").distinct().join(sets.withColumnRenamed("items", "held"), "fp")
             .join(known.select("item_id", "n_shingles", "items"), "item_id")
             .select("fp", "item_id", "n_shingles", F.size(F.array_intersect("held", "items")).cast("long").alias("n_found"))
             .filter(F.lit(100) * F.col("n_found") >= F.lit(percent) * F.col("n_shingles")).distinct())
    return found.join(passed.select("fp", "doc_id", "item_id"), ["fp", "item_id"]).select("doc_id", "fp", "item_id", "n_shingles", "n_found")


OP6_SQL = r"""
WITH words AS (
    SELECT kind, id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark)),
sets AS (
    SELECT kind, id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM words),
grams AS (SELECT kind, id, len(s) AS n, unnest(s) AS g FROM sets)
SELECT d.id AS doc_id, i.id AS item_id, i.n::BIGINT AS n_shingles, count(*)::BIGINT AS n_found
FROM grams d JOIN grams i ON d.kind = 'd' AND i.kind = 'i' AND d.g = i.g
GROUP BY d.id, i.id, i.n HAVING 100 * count(*) >= 80 * i.n
"""


@query("op6_decontamination", OP6_SQL)
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_found")


def without_items(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that contain no item, as they are."""
    return rows_without(docs, contained_items(docs, items, n, percent).select("doc_id", "fp"), n)
