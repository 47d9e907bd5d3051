"""N-gram Jaccard self-join by PartEnum signatures (Arasu, Ganti and Kaushik, 2006).

Set sizes are cut into bands such that sets of Jaccard similarity t or more lie in the same or in neighbouring bands. In
the instance of a band (its sets and those of the band before) such sets differ in k features at most. The feature domain is parted by
hash into k + 1 parts: two such sets agree on one of them. The signature of a set is the content of a part, with instance and part; each
set enumerates its signatures in its own instance and in the next. (This is the enumeration with one second-level part, the fewest
signatures; the exact check makes up for its weaker filter.)

Two sets could agree only on a part that is empty in both. An empty part gives no signature; a set that has one enumerates another scheme with another hash,
until a scheme leaves it no empty part, so the two meet there (at the latest in scheme SCHEMES, where empty parts sign too). Past CHAIN_PARTS parts the chance that k differences
hit every other part is below 1e-27, and no further scheme is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcell.llm import bitmaps
from weekcell.llm.components import connected_components, written
from weekcell.llm.registry import query, table
from weekcell.llm.words import distinct_by_row, mix, shingles, span_hashes, text_bytes, text_chunks, word_spans

#: Parts beyond which an empty part needs no further scheme.
CHAIN_PARTS = 64
#: Schemes of a set at most; in the last one its empty parts sign too (which low similarities alone need).
SCHEMES = 12
#: Bits of the sketch of a set for each of its features, rounded up to a power of two: parities of features by hash, so that two sketches
#: differ in no more bits than the sets do in features. With two bits a feature few differences meet in a bit, and the bound is close.
SKETCH = 2
#: Bits of the filter that picks the rows whose sets are fetched; it has this size for any input.
FILTER_BITS = 1 << 23
#: Bits of the first half of a set's hint, a long: its size (up to HINT_SIZE) above that many of the parities of its features. The second half has 64 more.
HINT_BITS = 54
HINT_SIZE = (1 << 63 - HINT_BITS) - 1
#: Star rounds before the pairs that are left are enumerated.
STAR_ROUNDS = 3
#: Bytes of text whose shingles are worked on at once: hashes, sort keys and signatures take many times that.
PIECE_BYTES = 1 << 20
#: Sets that a worker remembers to leave out repeated ones.
REMEMBERED = 200_000


def band_edges(percent: int, upto: int) -> np.ndarray:
    """First sizes of the bands: band i holds sizes edges[i] to edges[i + 1] - 1 = floor(edges[i] * 100 / percent)."""
    edges = [1]
    while edges[-1] <= upto:
        edges.append(edges[-1] * 100 // percent + 1)
    edges.append(edges[-1] * 100 // percent + 1)
    edges.append(edges[-1] * 100 // percent + 1)
    return np.array(edges, dtype=np.int64)


def most_different(percent: int, total):
    """Features in one of two sets but not in both, at most, for sets of ``total`` features counted apart."""
    return total * (100 - percent) // (100 + percent)


def part_signatures(values: np.ndarray, rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of the sets in rows[k]:rows[k + 1] of ``values``."""
    sizes = np.diff(rows)
    edges = band_edges(percent, int(sizes.max(initial=1)))
    band = np.searchsorted(edges, sizes, side="right") - 1
    out_rows, out = [], []
    for ahead in (0, 1):
        instance = band + ahead
        parts = most_different(percent, 2 * (edges[instance + 1] - 1)) + 1
        todo, scheme = np.flatnonzero((parts > 1) & (sizes > 0)), 0
        while len(todo):
            n = sizes[todo]
            owner = np.repeat(np.arange(len(todo)), n)
            x = values[np.repeat(rows[todo], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            seed = mix((instance[todo] * 64 + scheme + 1).astype(np.uint64))
            place = ((mix(x ^ seed[owner]) >> np.uint64(32)) * parts[todo].astype(np.uint64)[owner]) >> np.uint64(32)
            key = owner.astype(np.int64) * (1 << 32) + place.astype(np.int64)
            order = np.argsort(key, kind="stable")
            key, x = key[order], mix(x[order] + np.uint64(scheme))
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            who, where = key[first] >> 32, (key[first] & 0xFFFFFFFF).astype(np.uint64)
            content = np.add.reduceat(x, first)
            out.append(mix(mix(content + where) ^ seed[who]))
            out_rows.append(todo[who])
            filled = np.bincount(who, minlength=len(todo))
            left = (filled < parts[todo]) & (parts[todo] <= CHAIN_PARTS)
            if scheme == SCHEMES - 1:  # sets that no scheme fills: here the empty parts sign too
                rest = np.flatnonzero(left)
                n = parts[todo[rest]]
                every = np.repeat(rest << 32, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                empty = np.setdiff1d(every, key[first], assume_unique=True)
                out.append(mix(mix((empty & 0xFFFFFFFF).astype(np.uint64)) ^ seed[empty >> 32]))
                out_rows.append(todo[empty >> 32])
                break
            todo, scheme = todo[left], scheme + 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_rows), np.concatenate(out)


def set_rows(column: pa.Array, low: int, high: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by row, and a fingerprint of each set."""
    data, offsets = text_bytes(column, low, high)
    starts, lengths, word_rows = word_spans(data, offsets)
    values, rows = distinct_by_row(*shingles(span_hashes(data, starts, lengths), word_rows, n))
    return values, rows, fingerprints(values, rows)


def fingerprints(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A fingerprint of each set of distinct shingles."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values + np.uint64(11)), dtype=np.uint64)])
    return mix((sums[rows[1:]] - sums[rows[:-1]]) + np.diff(rows).astype(np.uint64))


def parity_sketches(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, bounds): bit b of set k is the parity of its features whose hash ends in b; its 64-bit words are words[bounds[k]:bounds[k + 1]].

    A set of s features has the least power of two of bits that is no less than SKETCH * s and 64. Its halves xor-ed are the
    sketch of half the length, so sketches of different lengths can be compared.
    """
    sizes = np.diff(rows)
    bits = np.int64(1) << np.ceil(np.log2(np.maximum(SKETCH * sizes, 64))).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = starts[owner] + (mix(values + np.uint64(5)).view(np.int64) & (bits[owner] - 1))
    odd = (np.bincount(at, minlength=int(starts[-1])) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64), starts >> 6


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, sizes, prints, words, lengths = batch.column("text"), [], [], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
            for low, high in text_chunks(column, PIECE_BYTES):
                values, rows, fp = set_rows(column, low, high, n)
                sketch, bounds = parity_sketches(values, rows)
                sizes.append(np.diff(rows))
                prints.append(fp)
                words.append(sketch)
                lengths.append(np.diff(bounds))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(lengths)), pa.int32()), pa.array(np.concatenate(words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()),
                 pa.array(np.concatenate(prints).view(np.int64) if prints else [], pa.int64()), lists],
                ["doc_id", "n_shingles", "fp", "sketch"])
    return run


def _signatures(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            column = batch.column("text")
            for low, high in text_chunks(column, PIECE_BYTES):
                values, rows, fp = set_rows(column, low, high, n)
                new = np.zeros(high - low, dtype=bool)
                for k, x in enumerate(fp.tolist()):
                    if rows[k + 1] > rows[k] and x not in seen:
                        new[k] = True
                        if len(seen) < REMEMBERED:
                            seen.add(x)
                pick = np.repeat(new, np.diff(rows))
                kept = np.concatenate([[0], np.cumsum(np.diff(rows)[new])])
                owner, sig = part_signatures(values[pick], kept, percent)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(fp[new][owner].view(np.int64))], ["sig", "fp"])
    return run


def fetch_sets(n: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = bits.value
        for batch in batches:
            slot = np.asarray(batch.column("slot"))
            batch = batch.filter(pa.array(bitmaps.holds(filled, slot)))
            column = batch.column("text")
            for low, high in text_chunks(column, PIECE_BYTES):
                values, rows, fp = set_rows(column, low, high, n)
                lists = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), lists], ["fp", "items"])
    return run


def hints(n_shingles: Column, sketch: Column) -> list[Column]:
    """Size and parities of a set in two longs (h1, h2), so that the rows of a signature can carry them.

    A sketch of one word has no second half; one of several is folded to two words, which keep apart what a single word would mix.
    """
    def folded(words: Column) -> Column:
        return F.aggregate(words, F.lit(0).cast("bigint"), lambda sofar, word: sofar.bitwiseXOR(word))
    even, odd = F.filter(sketch, lambda _, k: k % 2 == 0), F.filter(sketch, lambda _, k: k % 2 == 1)
    size = F.least(n_shingles, F.lit(HINT_SIZE)).cast("bigint")
    first = F.shiftleft(size, HINT_BITS).bitwiseOR(folded(even).bitwiseAND(F.lit((1 << HINT_BITS) - 1)))
    return [first.alias("h1"), F.when(F.size(sketch) > 1, folded(odd)).alias("h2")]


def may_link(left: str, right: str, percent: int) -> Column:
    """Whether the hints (h1, h2) of two sets leave a link open: parities differ in no more places than the sets do in features.

    Sizes of HINT_SIZE or more leave it open, and so does a sketch of one word beside one of several.
    """
    x, y = F.col(f"{left}h1"), F.col(f"{right}h1")
    p, q = F.col(f"{left}h2"), F.col(f"{right}h2")
    a, b = F.shiftright(x, HINT_BITS), F.shiftright(y, HINT_BITS)
    gap = F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit((1 << HINT_BITS) - 1))) + F.coalesce(F.bit_count(p.bitwiseXOR(q)), F.lit(0))
    return (F.greatest(a, b) >= HINT_SIZE) | (p.isNull() != q.isNull()) | (gap * F.lit(100 + percent) <= (a + b) * F.lit(100 - percent))


class NgramJoin:
    """The join over one table: its classes of equal sets, links between classes, and components.

    ``docs`` has doc_id and text. Words are runs of other bytes than ASCII white space, A-Z in lower case; a text
    with fewer than ``n`` words is one shingle; a null text or one without words has no shingle and no link. Rows
    with equal doc_id are separate documents. Sets are known by 64-bit hashes of their shingles.
    """

    def __init__(self, docs: DataFrame, n: int = 5, percent: int = 80):
        self.n, self.percent = n, percent
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        self.base = written(self.docs.mapInArrow(_fingerprints(n), "doc_id long, n_shingles long, fp long, sketch array<bigint>"), "base")

    def _close(self, left: str, right: str) -> Column:
        """Cheap conditions that every link meets: sizes, and bits in which the sketches differ."""
        a, b = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
        x, y = F.col(f"{left}.sketch"), F.col(f"{right}.sketch")

        def folded(longer: Column, other: Column) -> Column:
            half = (F.size(longer) / 2).cast("int")
            return F.when(F.size(longer) > F.size(other), F.zip_with(
                F.slice(longer, 1, half), F.slice(longer, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(longer)
        gap = F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, d: total + d)
        # lengths more than two times apart (low similarities alone) are not compared
        near = F.greatest(F.size(x), F.size(y)) <= 2 * F.least(F.size(x), F.size(y))
        return ((F.lit(100) * F.least(a, b) >= F.lit(self.percent) * F.greatest(a, b))
                & (~near | (gap * F.lit(100 + self.percent) <= (a + b) * F.lit(100 - self.percent))))

    def _linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Of pairs (u, v), those whose similarity is high enough, by exact counts."""
        both = (pairs.join(sets.select(F.col("fp").alias("u"), F.col("items").alias("left")), "u")
                .join(sets.select(F.col("fp").alias("v"), F.col("items").alias("right")), "v"))
        common = F.size(F.array_intersect("left", "right"))
        return (both.select("u", "v", common.alias("common"), (F.size("left") + F.size("right") - common).alias("total"))
                .filter(F.lit(100) * F.col("common") >= F.lit(self.percent) * F.col("total")).select("u", "v"))

    def roots(self) -> DataFrame:
        """(u, root) of classes (fingerprints) that links connect with others, root being the least class of the component.

        Signatures are dealt by value once. Per signature, classes are first compared with the one that shares most signatures
        with others (the text that the others are copies of, as a rule), then with others in turn; classes that a
        link has joined need no comparison among them, so a group of near copies costs its size, not its square. A class that
        was the centre of a signature is settled there and leaves it. Rows of signatures carry hints, so that most classes that only share a passage
        are told apart where they meet and no pair of them is made. What a round has linked goes on as one edge from each class to its root.
        After STAR_ROUNDS rounds, the pairs of classes that still share a signature and are apart are compared, if size and sketch allow a link; nothing is left out.
        """
        signatures = self.docs.select("text").mapInArrow(_signatures(self.n, self.percent), "sig long, fp long")
        same = Window.partitionBy("sig")
        shared = written(signatures.withColumns({"least": F.min("fp").over(same), "most": F.max("fp").over(same)})
                         .filter("least < most").select("sig", "fp").distinct(), "shared")
        if shared.isEmpty():
            return shared.selectExpr("fp AS u", "fp AS root")
        sizes = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("size"))
        degrees = shared.join(sizes, "sig").groupBy("fp").agg(F.sum("size").alias("degree"))
        wanted = shared.select("fp").distinct()
        classes = self.base.filter("n_shingles > 0").groupBy("fp").agg(
            F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc_id"))
        info = written(classes.join(degrees, "fp").select("*", *hints(F.col("n_shingles"), F.col("sketch"))), "info")
        bits = self.docs.sparkSession.sparkContext.broadcast(
            bitmaps.build(info.select(bitmaps.slot(F.col("doc_id"), FILTER_BITS).alias("slot")), FILTER_BITS))
        fetched = (self.docs.withColumn("slot", bitmaps.slot(F.col("doc_id"), FILTER_BITS)).mapInArrow(fetch_sets(self.n, bits), "fp long, items array<bigint>"))
        sets = written(fetched.join(wanted, "fp", "left_semi").dropDuplicates(["fp"]), "sets")
        traits = info.select("fp", "n_shingles", "sketch")
        labels, rest = None, shared
        for turn in range(STAR_ROUNDS + 1):
            if labels is None:
                held = rest.join(info.select("fp", "degree", "h1", "h2"), "fp").withColumn("root", F.col("fp"))
            else:
                held = rest.join(labels.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
                open_ = held.groupBy("sig").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("sig")
                held = written(held.join(open_, "sig", "left_semi").select("sig", "fp", "root", "h1", "h2"), "held")
                if held.isEmpty():
                    break
            if turn < STAR_ROUNDS:
                rank = F.struct("degree", "fp") if turn == 0 else F.struct(F.xxhash64("fp", F.lit(turn)), "fp")
                centre = held.groupBy("sig").agg(F.max_by(F.struct("fp", "root", "h1", "h2"), rank).alias("c"))
                starred = written(held.join(centre, "sig").select("sig", "fp", "root", "h1", "h2", "c"), "starred")
                rest = starred.filter(F.col("fp") != F.col("c.fp")).select("sig", "fp", "h1", "h2")
                pairs = (starred.filter((F.col("root") != F.col("c.root")) & may_link("", "c.", self.percent))
                         .select(F.greatest("fp", "c.fp").alias("u"), F.least("fp", "c.fp").alias("v")).distinct())
                named = (pairs.join(traits.withColumnRenamed("fp", "u").select("u", F.struct("n_shingles", "sketch").alias("a")), "u")
                         .join(traits.withColumnRenamed("fp", "v").select("v", F.struct("n_shingles", "sketch").alias("b")), "v"))
                pairs = named.filter(self._close("a", "b")).select("u", "v")
            else:
                # pairs within the largest group of joined classes need no look: one side is the rest
                rich = held.join(traits, "fp")
                largest = (held.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("size"))
                           .groupBy("sig").agg(F.max_by("root", F.struct("size", "root")).alias("largest")))
                left, right = rich.join(largest, "sig").filter("root <> largest").alias("l"), rich.alias("r")
                pairs = (left.join(right, (F.col("l.sig") == F.col("r.sig")) & (F.col("l.root") != F.col("r.root"))
                                   & may_link("l.", "r.", self.percent) & self._close("l", "r"))
                         .select(F.greatest("l.fp", "r.fp").alias("u"), F.least("l.fp", "r.fp").alias("v")).distinct())
            found = self._linked(pairs, sets)
            found = written(found, "found")
            if labels is not None and found.isEmpty():
                continue  # nothing is joined that was apart
            edges = found if labels is None else found.union(labels.filter("u <> root").select("u", F.col("root").alias("v")))
            labels = written(connected_components(edges), "labels")
        return labels

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id (least doc_id of the component), fp and the component's root for every row of ``docs``."""
        rooted = self.base.select("doc_id", "n_shingles", "fp").join(self.roots().withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        least = (rooted.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")))
        return (rooted.join(least, "root", "left")
                .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "fp", "root"))


def _marked(n: int, keep: list[str], bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, sizes, prints = batch.column("__text"), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for low, high in text_chunks(column, PIECE_BYTES):
                _, rows, fp = set_rows(column, low, high, n)
                sizes.append(np.diff(rows))
                prints.append(fp)
            doubt = bitmaps.holds(bits.value, np.asarray(batch.column("__slot")))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(prints).view(np.int64)), pa.array(doubt)],
                [*keep, "__n", "__fp", "__doubt"])
    return run


def rows_without(docs: DataFrame, dropped: DataFrame, n: int, once: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` but those of ``dropped`` (doc_id, fp); of equal pairs of ``once`` (doc_id, fp), one row stays.

    Most rows are told from a bitmap of fixed size to be neither, and stay where they are; the others meet the two tables in an exact join.
    """
    spark, columns = docs.sparkSession, docs.columns
    dropped = written(dropped.distinct(), "dropped")
    named = dropped.select("doc_id") if once is None else dropped.select("doc_id").union(once.select("doc_id"))
    bits = spark.sparkContext.broadcast(bitmaps.build(named.select(bitmaps.slot(F.col("doc_id"), FILTER_BITS).alias("slot")), FILTER_BITS))
    schema = T.StructType([*docs.schema.fields, T.StructField("__n", T.LongType()), T.StructField("__fp", T.LongType()), T.StructField("__doubt", T.BooleanType())])
    marked = (docs.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit("")))
              .withColumn("__slot", bitmaps.slot(F.col("doc_id").cast("long"), FILTER_BITS)).mapInArrow(_marked(n, columns, bits), schema))
    doubt = marked.filter("__doubt AND __n > 0").alias("m")
    left = doubt.join(dropped.alias("d"), F.col("m.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("m.__fp") == F.col("d.fp")), "left_anti")
    if once is not None:
        left = left.dropDuplicates(["doc_id", "__fp"])
    return marked.filter("NOT __doubt OR __n = 0").unionByName(left).select(*[F.col(f"`{c}`") for c in columns])


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, one for each component of similar documents: that with the least doc_id (then fingerprint).

    Documents without words are groups of their own and all stay.
    """
    labelled = NgramJoin(docs, n, percent).components().filter("n_shingles > 0")
    first = written(labelled.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("f"))
                    .select("root", F.col("f.doc_id").alias("first_id"), F.col("f.fp").alias("first_fp")), "first")
    pairs = labelled.groupBy("root", "doc_id", "fp").agg(F.count(F.lit(1)).alias("copies")).join(first, "root")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("fp") == F.col("first_fp"))
    return rows_without(docs, pairs.filter(~is_first).select("doc_id", "fp"), n,
                        once=pairs.filter(is_first & (F.col("copies") > 1)).select("doc_id", "fp"))


OP2_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
    FROM words),
items AS (SELECT doc_id, hash(unnest(s)) AS g FROM sets),
pairs AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
    SELECT u, v FROM pairs JOIN sets a ON a.doc_id = u JOIN sets b ON b.doc_id = v
    WHERE 100 * common >= 85 * (len(a.s) + len(b.s) - common)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(start, node) AS (
    SELECT u, u FROM both_ways UNION SELECT r.start, b.v FROM reach r JOIN both_ways b ON r.node = b.u),
least AS (SELECT start, min(node) AS component_id FROM reach GROUP BY start)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sets LEFT JOIN least ON start = doc_id
"""


@query("op2_ngram_join", OP2_SQL)
def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    join = NgramJoin(table(spark, folder, "documents"), n=4, percent=85)
    return join.components().select("doc_id", "n_shingles", "component_id")
