"""Stupid-backoff scores of documents (Brants et al., 2007), with the counts of the same corpus.

S(w | context) is count(context w) / count(context) where the n-gram occurs LEAST times or more in the corpus, else BACKOFF times the score
with a context shorter by one word; without context it is count(w) / words of the corpus. A document's score is the sum of log S.

Documents are dealt into blocks of about BLOCK_BYTES of text. A block explodes into its distinct n-grams with their
counts, dealt by ranges of hash: one row for each block and range, n-grams packed. Each range sums its table of counts and joins
it back to the rows, so a frequent n-gram costs a number for each block, not for each occurrence. The block's
rows come back to its texts and are summed by document. Block and range sizes are fixed, their number grows with the text.

n-grams are known by 56-bit hashes: one shares its hash with another with a chance of (distinct n-grams) / 2**56.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcell.llm.components import written
from weekcell.llm.registry import query, table
from weekcell.llm.words import chain, span_hashes, text_bytes, text_chunks, word_spans

BACKOFF = 0.4
LEAST = 2
BLOCK_BYTES = 8 << 20
_HASH = np.uint64((1 << 56) - 1)


def _grams(column: pa.Array, order: int):
    """Per order the hashes of n-grams by their last word (0 where the document has too few words before), and words by row."""
    hashes, rows = [[] for _ in range(order)], [0]
    for low, high in text_chunks(column):
        data, offsets = text_bytes(column, low, high)
        starts, lengths, word_rows = word_spans(data, offsets)
        words = span_hashes(data, starts, lengths)
        place = np.arange(len(words)) - np.repeat(word_rows[:-1], np.diff(word_rows))
        for n in range(1, order + 1):
            h = np.zeros(len(words), dtype=np.uint64)
            h[n - 1:] = (chain(words, n) & _HASH) | np.uint64(1)
            hashes[n - 1].append(np.where(place >= n - 1, h, np.uint64(0)))
        rows += (word_rows[1:] + rows[-1]).tolist()
    return [np.concatenate(h) if h else np.zeros(0, np.uint64) for h in hashes], np.array(rows)


def _pack(values: np.ndarray) -> tuple[int, int, bytes]:
    """First value, bytes of a step, and the steps between sorted values in so many bytes each."""
    steps = np.diff(values)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return int(values[0]), width, steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(first: int, width: int, data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    steps = np.zeros((len(raw), 8), dtype=np.uint8)
    steps[:, :width] = raw
    return np.uint64(first) + np.concatenate([[np.uint64(0)], np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)])


def _ranges(values: np.ndarray, parts: int) -> np.ndarray:
    """The range of each hash, by its upper 24 bits."""
    return ((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(24)


def _distinct(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(hashes)
    return np.unique(every[every > 0], return_counts=True)


EXPLODED = "block long, part long, first long, width int, steps binary, counts binary"


def _explode(order: int, parts: int):
    def run(block: pa.Table) -> pa.Table:
        column = block.column("text").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        values, counts = _distinct(_grams(column, order)[0])
        part = _ranges(values, parts)
        cut = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(values)) if len(values) else [0]
        rows = []
        for a, b in zip(cut[:-1], cut[1:]):
            first, width, steps = _pack(values[a:b])
            rows.append((int(part[a]), first, width, steps, counts[a:b].astype("<u4").tobytes()))
        part, first, width, steps, held = zip(*rows) if rows else ((), (), (), (), ())
        return pa.table({"block": pa.array([block.column("block")[0].as_py()] * len(rows), pa.int64()), "part": pa.array(part, pa.int64()),
                         "first": pa.array(first, pa.int64()), "width": pa.array(width, pa.int32()),
                         "steps": pa.array(steps, pa.binary()), "counts": pa.array(held, pa.binary())})
    return run


def _count(part: pa.Table) -> pa.Table:
    """Of one range: the corpus's count of each n-gram of each row, in the row's order."""
    grams = [_unpack(f, w, s) for f, w, s in zip(part.column("first").to_pylist(), part.column("width").to_pylist(), part.column("steps").to_pylist())]
    counts = [np.frombuffer(c, "<u4") for c in part.column("counts").to_pylist()]
    every, owner = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(owner, weights=np.concatenate(counts), minlength=len(every))
    found = np.minimum(totals, 2 ** 32 - 1).astype("<u4")[owner]
    cut = np.cumsum([0] + [len(g) for g in grams])
    return pa.table({"block": part.column("block"), "part": part.column("part"),
                     "totals": pa.array([found[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())})


def _score(order: int, backoff: float, least: int):
    def run(block: pa.Table, counted: pa.Table) -> pa.Table:
        if not block.num_rows:
            return block.select([]).append_column("doc_id", pa.array([], pa.int64()))
        column = block.column("text").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        hashes, rows = _grams(column, order)
        values, _ = _distinct(hashes)
        by_part = sorted(zip(counted.column("part").to_pylist(), counted.column("totals").to_pylist()))
        totals = np.concatenate([np.frombuffer(t, "<u4") for _, t in by_part] or [np.zeros(0, "<u4")]).astype(float)
        if len(totals) != len(values):
            raise RuntimeError("the counts that came back are not those of the block's n-grams")
        n_words = len(hashes[0])
        count = [np.where(h > 0, totals[np.minimum(np.searchsorted(values, h), max(len(values) - 1, 0))], 0.0) if len(values) else np.zeros(0) for h in hashes]
        log, todo, bare = np.zeros(n_words), np.ones(n_words, dtype=bool), np.zeros(n_words, dtype=bool)
        for n in range(order, 1, -1):
            seen = todo & (hashes[n - 1] > 0) & (count[n - 1] >= least)
            at = np.flatnonzero(seen)
            log[at] += np.log(count[n - 1][at] / count[n - 2][at - 1])
            todo &= ~seen
            log[todo & (hashes[n - 1] > 0)] += np.log(backoff)
        log[todo] += np.log(count[0][todo])
        bare = todo
        owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        sums = [np.bincount(owner, weights=x, minlength=len(rows) - 1).astype(float) for x in (log, bare)]
        return pa.table({"doc_id": block.column("doc_id"), "n_words": pa.array(np.diff(rows).astype(np.int64)),
                         "partial": pa.array(sums[0]), "n_bare": pa.array(sums[1].astype(np.int64))})
    return run


def score_documents(docs: DataFrame, order: int = 2, backoff: float = BACKOFF, least: int = LEAST,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_bare (words scored without context), log_score (natural logarithm), mean_log_score; a row for each row of ``docs``.

    Words are runs of other bytes than ASCII white space, A-Z in lower case. A null text, or one without words, has log_score 0 and
    a null mean. Rows with equal doc_id are scored one by one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    # one exchange of the texts serves both passes
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(blocks, "block")
    exploded = dealt.groupBy("block").applyInArrow(_explode(order, blocks), EXPLODED)
    counted = exploded.repartition(blocks, "part").groupBy("part").applyInArrow(_count, "block long, part long, totals binary").repartition(blocks, "block")
    scored = written(dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(
        _score(order, backoff, least), "doc_id long, n_words long, partial double, n_bare long"), "scored")
    words = scored.agg(F.sum("n_words")).first()[0] or 1
    total = F.col("partial") - F.col("n_bare") * F.log(F.lit(float(max(words, 1))))
    return scored.select("doc_id", "n_words", "n_bare", total.alias("log_score"),
                         F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_score"))


OP4_SQL = r"""
WITH words AS (
    SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
places AS (SELECT r, doc_id, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM words)),
one AS (SELECT a, count(*) AS n FROM places GROUP BY a),
two AS (SELECT b, a, count(*) AS n FROM places WHERE b IS NOT NULL GROUP BY b, a),
total AS (SELECT count(*) AS n FROM places),
steps AS (
    SELECT p.r, CASE WHEN two.n >= 2 THEN ln(two.n / c.n)
        ELSE CASE WHEN p.b IS NULL THEN 0 ELSE ln(0.4) END + ln(o.n) - ln(total.n) END AS s, NOT coalesce(two.n >= 2, false) AS bare
    FROM places p JOIN one o ON o.a = p.a LEFT JOIN one c ON c.a = p.b LEFT JOIN two ON two.a = p.a AND two.b = p.b, total),
sums AS (SELECT r, sum(s) AS s, count(*) AS n, count(*) FILTER (WHERE bare) AS bare FROM steps GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(bare, 0)::BIGINT AS n_bare, round(coalesce(s, 0), 5) AS log_score
FROM words LEFT JOIN sums USING (r)
"""


@query("op4_lm_score", OP4_SQL)
def op4_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_documents(table(spark, folder, "documents"))
    return scored.select("doc_id", "n_words", "n_bare", F.round("log_score", 5).alias("log_score"))
