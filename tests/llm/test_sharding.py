import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from weekcell.llm.sharding import assign_shards, jump_hash, shard_slots, sized


def published(key, n):
    key, b, j = key % 2 ** 64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    draw = random.Random(1)
    keys = [0, 1, -1, 2 ** 63 - 1, -2 ** 63, *(draw.randrange(-2 ** 63, 2 ** 63) for _ in range(400)), *range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 13, 40, 41, 5000):
        got = {r.k: r.s for r in df.select("k", jump_hash(F.col("k"), n).alias("s")).collect()}
        assert got == {k: published(k, n) for k in keys}


def test_slots_and_growth(spark):
    rows = [(k, f"text {k % 7}") for k in range(500)] + [(3, "again")] * 40 + [(None, None), (None, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = shard_slots(sized(docs), 10, buckets=4).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.shard == published(r.doc_id or 0, 10) and r.grown_shard in (r.shard, 10)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_slots(sized(docs.limit(0)), 10).collect() == []
    assert assign_shards(docs, "doc_id", 10).select("shard").distinct().count() == 10
