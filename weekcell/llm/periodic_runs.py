"""Periodic runs of words by block convolution at dyadic scales.

A run of period q and length L >= 4q is looked for at the scale B, the power of two with B <= q < 2B. Words are numbered within their
document. A text is cut into blocks of B words; with every block u and the window w of the 2B - 1 words that start B after it, an exact
integer number-theoretic transform gives the sums of (u[i] - w[d - B + i])**2 for all distances d of B to 2B - 1. A sum of
zero means that the block occurs again d words later.

Why no run is missed: the first block that starts in the run starts before its B-th word, and it and its copy q words later end before
3q words: floor((3q - B + 1) / B) blocks in a row, two at least, match at distance q. Such a row of blocks is a seed. It lacks fewer than B words
at either side of the whole stretch, which comparisons of words then find. Stretches that lie in a run of an earlier scale have that run's shorter
period, for both periods fit into them, and are dropped; so the distance of every stretch that is left is its smallest period.

The sums are taken modulo a prime. They are exact below it, and a sum that is a multiple of it can only add a seed, which the
comparison of its words removes. So results are exact for every text.

Words that can't be in a run of a scale are left out before: each word of a run belongs to four equal words within 3q words.

Memory is some hundred bytes a word of the texts worked on at once (``CHUNK_BYTES`` of text, or one longer text). The longest text
tested is 12 MB.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcell.llm import exact_ntt
from weekcell.llm.quality import let, words_of
from weekcell.llm.registry import query, table
from weekcell.llm.splitting import word_lists
from weekcell.llm.words import text_chunks

#: A run holds its period LEAST_REPEATS times at least and LEAST_WORDS words.
LEAST_REPEATS = 4
LEAST_WORDS = 6
#: Bytes of text that one task works on at once.
CHUNK_BYTES = 2 << 20
#: Numbers in one transform of many blocks.
_SLAB = 1 << 16


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] numbers, then those of starts[1], and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _spans(keys: np.ndarray) -> np.ndarray:
    """For each word the least distance from first to last of four equal words in a row that it is one of. ``keys`` differ between documents."""
    n = len(keys)
    out = np.full(n, np.iinfo(np.int64).max)
    if n < LEAST_REPEATS:
        return out
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    span = np.where(held[3:] == held[:-3], order[3:] - order[:-3], np.iinfo(np.int64).max)
    best = np.full(n, np.iinfo(np.int64).max)
    for k in range(LEAST_REPEATS):
        np.minimum(best[k:n - 3 + k], span, out=best[k:n - 3 + k])
    out[order] = best
    return out


def _segments(alive: np.ndarray, starts_doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of ``least`` words or more that are alive and lie in one document."""
    edge = np.diff(alive.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = starts_doc[alive[starts_doc] & (starts_doc > 0)]
    cuts = cuts[alive[cuts - 1]]
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def _matches(x: np.ndarray, blocks: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the block, distance) of every block of ``size`` words that occurs again in the window behind it.

    ``blocks`` are starts, ``ends`` the ends of their segments; the sum of squared differences decides, modulo the prime.
    """
    width = 2 * size
    step = max(1, _SLAB // width)
    prime = np.uint64(exact_ntt.PRIME)
    out_block, out_shift = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, len(blocks), step):
        at, end = blocks[low:low + step], ends[low:low + step]
        lags = np.arange(size)[:, None]
        u = x[at[None, :] + lags]
        places = at[None, :] + size + np.arange(width - 1)[:, None]
        w = np.where(places < end[None, :], x[np.minimum(places, len(x) - 1)], np.uint64(0))
        # correlation: the block is reversed, so that the product's place size - 1 + d belongs to lag d
        left = np.zeros((width, len(at)), dtype=np.uint64)
        left[:size] = u[::-1]
        right = np.zeros((width, len(at)), dtype=np.uint64)
        right[:width - 1] = w
        both = exact_ntt.inverse(exact_ntt.product(exact_ntt.transform(left), exact_ntt.transform(right)))
        cross = both[size - 1 + np.arange(size)]
        squares = np.concatenate([np.zeros((1, len(at)), np.uint64), np.cumsum(w * w % prime, axis=0, dtype=np.uint64)])
        sums = (u * u % prime).sum(axis=0, dtype=np.uint64)[None, :] + squares[size:] - squares[:-size]
        zero = (sums + np.uint64(2) * (prime - cross)) % prime == 0
        zero &= at[None, :] + 2 * size + lags <= end[None, :]
        lag, k = np.nonzero(zero)
        out_block.append(low + k)
        out_shift.append(size + lag)
    return np.concatenate(out_block), np.concatenate(out_shift)


def _agree(x: np.ndarray, at: np.ndarray, shift: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on, going by ``step``, equal those ``shift`` later; at most ``room``."""
    out = np.zeros(len(at), dtype=np.int64)
    todo, width = np.flatnonzero(room > 0), 8
    while len(todo):
        lags = np.arange(width)[None, :]
        inside = out[todo][:, None] + lags < room[todo][:, None]
        places = np.where(inside, at[todo][:, None] + step * (out[todo][:, None] + lags), 0)
        same = inside & (x[places] == x[np.where(inside, places + shift[todo][:, None], 0)])
        run = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
        out[todo] += run
        todo = todo[(run == width) & (out[todo] < room[todo])]
        width = min(2 * width, 1024)
    return out


class _Known:
    """Runs of earlier scales, to tell whether a stretch lies in one of them."""

    def __init__(self):
        self.start, self.end, self.period = (np.zeros(0, np.int64) for _ in range(3))
        self.reach = np.zeros(0, np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        start, end, period = (np.concatenate(p) for p in ((self.start, start), (self.end, end), (self.period, period)))
        order = np.lexsort((period, start))
        self.start, self.end, self.period = start[order], end[order], period[order]
        self.reach = np.maximum.accumulate(self.end) if len(start) else self.end

    def hold(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(len(start), dtype=bool)
        k = np.searchsorted(self.start, start, side="right") - 1
        return (k >= 0) & (self.reach[np.maximum(k, 0)] >= end)


def runs_of(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run, by start and period, of documents whose word numbers are ids[offsets[k]:offsets[k + 1]].

    Numbers count from 0 within each document.
    """
    x = ids.astype(np.uint64)
    sizes = np.diff(offsets)
    base = np.cumsum(np.concatenate([[0], [int(ids[a:b].max()) + 1 if b > a else 0 for a, b in zip(offsets[:-1], offsets[1:])]]))[:-1]
    spans = _spans(ids.astype(np.int64) + np.repeat(base, sizes))
    firsts = offsets[:-1][sizes > 0]
    known, size = _Known(), 1
    longest = int(sizes.max()) if len(sizes) else 0
    while LEAST_REPEATS * size <= longest:
        seg_start, seg_end = _segments(spans <= 3 * (2 * size - 1), firsts, LEAST_REPEATS * size)
        fresh = ~known.hold(seg_start, seg_end)  # all stretches of the others would lie in a run of an earlier scale
        seg_start, seg_end = seg_start[fresh], seg_end[fresh]
        if len(seg_start):
            known.add(*_scale(x, seg_start, seg_end, size, known))
        size *= 2
    keep = known.end - known.start >= np.maximum(LEAST_WORDS, LEAST_REPEATS * known.period)
    return known.start[keep], known.end[keep], known.period[keep]


def _scale(x: np.ndarray, seg_start: np.ndarray, seg_end: np.ndarray, size: int, known: _Known) -> tuple[np.ndarray, ...]:
    """Runs (start, end, period) with ``size`` <= period < 2 ``size`` in the segments."""
    per = (seg_end - seg_start) // size
    owner = np.repeat(np.arange(len(per)), per)
    number = _ranges(np.zeros(len(per), np.int64), per)
    blocks = seg_start[owner] + number * size
    block, shift = _matches(x, blocks, seg_end[owner], size)
    place = block + owner[block]  # a gap between the numbers of two segments
    while True:
        order = np.lexsort((place, shift))
        block, shift, place = block[order], shift[order], place[order]
        head = np.ones(len(block), dtype=bool)
        head[1:] = (shift[1:] != shift[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(head)
        count = np.diff(np.append(first, len(block)))
        low, d = blocks[block[first]], shift[first]
        high = low + count * size
        good = (count >= (3 * d - size + 1) // size) & ~known.hold(low, high + d)
        low, high, d, first, count = low[good], high[good], d[good], first[good], count[good]
        places = _ranges(low, high - low)
        wrong = np.flatnonzero(x[places] != x[places + np.repeat(d, high - low)])
        if not len(wrong):
            break
        group = np.searchsorted(np.cumsum(high - low), wrong, side="right")
        drop = np.unique(first[group] + (places[wrong] - low[group]) // size)
        block, shift, place = (np.delete(v, drop) for v in (block, shift, place))
    edge = np.searchsorted(seg_start, low, side="right") - 1
    left = _agree(x, low - 1, d, np.minimum(low - seg_start[edge], size), -1)
    right = _agree(x, high, d, np.minimum(seg_end[edge] - high - d, size), 1)
    start, end = low - left, high + right + d
    keep = end - start >= LEAST_REPEATS * d
    return start[keep], end[keep], d[keep]


def _numbered(text: str | None, seen: dict[bytes, int]) -> array:
    """The words of a text as numbers in order of appearance."""
    out = array("i")
    number = seen.setdefault
    for words in word_lists(text):
        out.extend([number(w, len(seen)) for w in words])
    return out


def _collapsed(text: str | None, keep: np.ndarray) -> str:
    parts, at = [], 0
    for words in word_lists(text):
        flags = keep[at:at + len(words)]
        parts.append(b" ".join([w for w, k in zip(words, flags.tolist()) if k]) if not flags.all() else b" ".join(words))
        at += len(words)
    return b" ".join(p for p in parts if p).decode("utf-8", "surrogatepass")


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        for low, high in text_chunks(column, CHUNK_BYTES):
            texts = column.slice(low, high - low).to_pylist()
            numbers = [_numbered(t, {}) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(v) for v in numbers])]).astype(np.int64)
            ids = np.concatenate([np.frombuffer(v, dtype=np.int32) for v in numbers])
            start, end, period = runs_of(ids, offsets)
            cover = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(cover, start + period, 1)
            np.add.at(cover, end, -1)
            keep = np.cumsum(cover)[:-1] == 0
            owner = np.searchsorted(offsets, start, side="right") - 1
            by_row = np.searchsorted(owner, np.arange(len(texts) + 1))
            runs = pa.StructArray.from_arrays([pa.array(start - offsets[owner]), pa.array(end - start), pa.array(period)],
                                              ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").slice(low, high - low), pa.array(np.diff(offsets)),
                 pa.ListArray.from_arrays(pa.array(by_row, pa.int32()), runs).cast(_RUNS),
                 pa.array([_collapsed(t, keep[a:b]) for t, a, b in zip(texts, offsets[:-1], offsets[1:])], pa.string())],
                ["row", "n_words", "runs", "collapsed"])


def find_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """(row, n_words, runs, collapsed) for each row of ``df``: the row itself as a struct, its number of words, its runs (start, length, period) by
    start and then period, and the words that no run holds after its first period, joined by one space.

    A null text and one without words have no runs and collapse to the empty string. Repeated rows each give a row. Columns of ``df`` may have any name,
    for the row travels as one struct. No shuffle; a text is worked on whole by the task that reads it.
    """
    columns = df.columns
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_find, f"row {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def without_repeats(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with each text that has a run replaced by its collapsed form; other texts stay as they are."""
    found = find_runs(df, text)
    return found.select(*[
        (F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("row")[c]) if c == text else F.col("row")[c]).alias(c)
        for c in df.columns])


def with_planted_repeats(text: Column, doc_id: Column) -> Column:
    """The text with the query's repeats: where h = crc32 of the decimal id is a multiple of 10, word i >= a becomes word
    a + (i - a) % p, with g = h / 10, a = g % n, p = 1 + (n - a) / (3 + g % 8) of n words. Other texts, and those of a null id, stay."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def changed(words: Column) -> Column:
        n = F.size(words).cast("long")
        return let(F.struct((g % n).alias("a"), (F.lit(1) + F.floor((n - g % n) / (F.lit(3) + g % 8))).alias("p")), lambda s: F.array_join(
            F.transform(words, lambda w, i: F.when(i < s["a"], w).otherwise(
                F.get(words, (s["a"] + (i - s["a"]) % s["p"]).cast("int")))), " "))
    return F.when(h % 10 == 0, let(words_of(text), lambda w: F.when(F.size(w) > 0, changed(w)).otherwise(text))).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from ``find_runs`` over (doc_id, text)."""
    longest = F.get(F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.signum(b["length"] - a["length"]).cast("int"))
                                 .when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int"))
                                 .otherwise(F.signum(a["period"] - b["period"]).cast("int"))), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    top = found.withColumn("top", F.when(F.size("runs") > 0, longest))
    return top.select(
        F.col("row")["doc_id"].alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("top")["start"].alias("start"),
        F.col("top")["length"].alias("length"), F.col("top")["period"].alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


OP11_SQL = r"""
WITH RECURSIVE codes(n, k, c) AS (
    SELECT i, 0, i FROM range(256) t(i)
    UNION ALL
    SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM codes WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM codes WHERE k = 8),
split AS (
    SELECT row_number() OVER () AS rid, doc_id,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS o FROM documents),
hashed AS (
    SELECT rid, doc_id, o, len(o) AS n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(
        string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295) AS h
    FROM split, crc),
planted AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM hashed),
words AS (
    SELECT rid, doc_id, CASE WHEN h % 10 = 0 AND n > 0
        THEN list_concat(o[1:a], list_transform(range(0, n - a), lambda i: o[1 + a + i % p])) ELSE o END AS w FROM planted),
placed AS (SELECT rid, unnest(w) AS word, unnest(range(0, len(w))) AS i, len(w) AS n FROM words),
often AS (SELECT *, count(*) OVER (PARTITION BY rid, word) AS times FROM placed),
same AS (
    SELECT x.rid, x.i, y.i - x.i AS d FROM often x JOIN often y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
    WHERE x.times >= 4 AND y.times >= 4),
stretch AS (
    SELECT rid, d, min(i) AS start, max(i) + 1 + d AS stop
    FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, d ORDER BY i) AS island FROM same) GROUP BY rid, d, island
    HAVING count(*) >= 3 * d),
runs AS (
    SELECT rid, start, stop, d AS period FROM stretch s WHERE NOT EXISTS (
        SELECT 1 FROM stretch t WHERE t.rid = s.rid AND t.d < s.d AND t.start <= s.start AND t.stop >= s.stop)
    AND stop - start >= 6),
summed AS (
    SELECT rid, count(*) AS n_runs, first(struct_pack(s := start, l := stop - start, q := period) ORDER BY stop - start DESC, start, period) AS top,
           string_agg(start || ',' || (stop - start) || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, stop)) AS i FROM runs),
kept AS (
    SELECT p.rid, string_agg(p.word, ' ' ORDER BY p.i) AS body FROM placed p ANTI JOIN gone g ON g.rid = p.rid AND g.i = p.i GROUP BY p.rid)
SELECT w.doc_id, coalesce(s.n_runs, 0)::BIGINT AS n_runs, s.top.s::BIGINT AS start, s.top.l::BIGINT AS length, s.top.q::BIGINT AS period,
       (1000 * s.top.l // s.top.q)::BIGINT AS exponent_milli, sha256(coalesce(s.lines, '')) AS runs_sha256, sha256(coalesce(k.body, '')) AS collapsed_sha256
FROM words w LEFT JOIN summed s USING (rid) LEFT JOIN kept k USING (rid)
"""


@query("op11_runs", OP11_SQL)
def op11_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return digest(find_runs(docs.withColumn("text", with_planted_repeats(F.col("text"), F.col("doc_id")))))
