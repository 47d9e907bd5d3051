"""Jump consistent hashing (Lamping and Veach, 2014) as Spark expressions, and gapless slots within shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekcell.llm.registry import query, table

#: Fixed values of the published generator: state = state * MULTIPLIER + 1 (mod 2**64), split into halves of 32 bits.
MULTIPLIER = 2862933555777941757
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_32 = 0xFFFFFFFF


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _jump(s: Column) -> Column:
    """One step: advance the generator, jump ahead. 64-bit products are built from parts that can't overflow."""
    lo, hi = s["lo"], s["hi"]
    even = lo.bitwiseAND(_long(0xFFFF)) * _long(_LOW) + _long(1)
    odd = F.shiftright(lo, 16) * _long(_LOW)
    low = even + F.shiftleft(odd.bitwiseAND(_long(0xFFFF)), 16)
    high = (F.shiftright(low, 32) + F.shiftright(odd, 16) + lo * _long(_HIGH)
            + hi.bitwiseAND(_long(0xFFFF)) * _long(_LOW)
            + F.shiftleft((F.shiftright(hi, 16) * _long(_LOW)).bitwiseAND(_long(0xFFFF)), 16)).bitwiseAND(_long(_32))
    step = F.lit(float(1 << 31)) / (F.shiftright(high, 1) + _long(1)).cast("double")
    return F.struct(high.alias("hi"), low.bitwiseAND(_long(_32)).alias("lo"), s["j"].alias("b"),
                    F.floor((s["j"] + _long(1)).cast("double") * step).cast("long").alias("j"))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard of a long key, 0 to shards - 1. With one more shard, a key stays or goes to the new one.

    A null key goes where key 0 goes. Every step moves ahead by a shard at least, so ``shards`` steps
    always suffice; nearly all keys need few, and only the others enter the second fold.
    """
    if shards < 1:
        raise ValueError("there must be a shard at least")
    key = F.coalesce(key.cast("long"), _long(0))
    start = F.struct(F.shiftrightunsigned(key, 32).bitwiseAND(_long(_32)).alias("hi"),
                     key.bitwiseAND(_long(_32)).alias("lo"), _long(-1).alias("b"), _long(0).alias("j"))

    def fold(state: Column, steps: int, finish) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state,
                           lambda s, _: F.when(s["j"] >= _long(shards), s).otherwise(_jump(s)), finish)

    few = min(shards, 14)
    if few == shards:
        return fold(start, few, lambda s: s["b"]).cast("int")
    rest = F.aggregate(F.array(fold(start, few, lambda s: s)), _long(0), lambda _, s: F.when(
        s["j"] >= _long(shards), s["b"]).otherwise(fold(s, shards - few, lambda t: t["b"])))
    return rest.cast("int")


def assign_shards(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; a column of that name is replaced."""
    return df.withColumn(name, jump_hash(F.col(key), shards))


def shard_slots(df: DataFrame, shards: int, buckets: int = 256) -> DataFrame:
    """Rows (doc_id, size, text_crc32) with shard, slot and the shard if there were one more.

    Slots count from 0 within a shard without gaps. Equal rows are folded into one with a count before any
    shuffle by key. A shard is cut into ``buckets`` by a checksum of the row, so no task holds a shard; bucket
    starts are sums over at most shards * buckets rows. Null doc_id counts as 0 for the shard and keeps its null.
    """
    row = [F.col(c) for c in ("doc_id", "size", "text_crc32")]
    folded = df.groupBy(*row).agg(F.count(F.lit(1)).alias("copies"))
    placed = (folded
              .withColumn("shard", jump_hash(F.col("doc_id"), shards))
              .withColumn("grown_shard", jump_hash(F.col("doc_id"), shards + 1))
              .withColumn("bucket", F.crc32(F.concat_ws(":", *row)) % F.lit(buckets)))
    starts = (placed.groupBy("shard", "bucket").agg(F.sum("copies").alias("held"))
              .withColumn("start", F.sum("held").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("held")))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    return (placed.withColumn("ahead", F.sum("copies").over(inside) - F.col("copies"))
            .join(starts.select("shard", "bucket", "start"), ["shard", "bucket"])
            .withColumn("slot", F.explode(F.sequence(F.col("start") + F.col("ahead"),
                                                     F.col("start") + F.col("ahead") + F.col("copies") - 1)))
            .select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 16) and the checksum of the text; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


OP1_SQL = """
WITH RECURSIVE codes(n, k, c) AS (
    SELECT i, 0, i FROM range(256) t(i)
    UNION ALL
    SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM codes WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM codes WHERE k = 8),
base AS (
    SELECT row_number() OVER () AS rid, doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
           coalesce(text, '') AS body FROM documents),
summed AS (
    SELECT rid, doc_id, size, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(
        list_filter(string_split(regexp_replace(hex(encode(body)), '(..)', '\\1 ', 'g'), ' '), lambda x: x <> ''),
        lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
    FROM base, crc),
jump(doc_id, state, b, j, n) AS (
    SELECT doc_id, coalesce(doc_id, 0)::HUGEINT & 18446744073709551615::HUGEINT, -1::BIGINT, 0::BIGINT, n
    FROM (SELECT DISTINCT doc_id FROM documents), (VALUES (40), (41)) v(n)
    UNION ALL
    SELECT doc_id, next, j, floor((j + 1) * (2147483648.0::DOUBLE / ((next >> 33) + 1)::DOUBLE))::BIGINT, n
    FROM (SELECT *, (state * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT AS next FROM jump WHERE j < n)),
placed AS (
    SELECT doc_id, max(b) FILTER (WHERE n = 40) AS shard, max(b) FILTER (WHERE n = 41) AS grown_shard
    FROM jump WHERE j >= n GROUP BY doc_id),
keyed AS (
    SELECT s.*, p.shard, p.grown_shard, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(
        string_split(concat_ws(':', s.doc_id, s.size, s.text_crc32), ''), lambda x: ascii(x)::BIGINT)),
        lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295) % 256 AS bucket
    FROM summed s JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id, crc)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       grown_shard::INTEGER AS grown_shard
FROM keyed
"""


@query("op1_shards", OP1_SQL)
def op1_shards(spark: SparkSession, folder: str) -> DataFrame:
    slots = shard_slots(sized(table(spark, folder, "documents")), shards=40)
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
