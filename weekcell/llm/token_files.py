"""Token ids as patched frame-of-reference blocks.

A *segment* is one row of a Parquet table, so that any store Spark reaches can hold it: whole documents of about
``SEGMENT_IDS`` ids (a longer document is a segment of its own), their ids and lengths, the packed blocks, and the
byte at which each block starts. A *block* is BLOCK_IDS ids (the last one of a segment may be shorter):

    u32 minimum | u8 width | u16 number of exceptions | u16 ids in the block
    the ids minus the minimum, their low ``width`` bits, little-endian, bit by bit, padded to a byte
    exceptions: u16 position each, then u32 value minus minimum each

The width is that of the 95th percentile of the block; larger values are exceptions and keep their low bits in place.
``part`` and ``segment`` give ascending doc_id order; ``first`` is the number of ids in the part before the segment.
"""

from __future__ import annotations

import codecs
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekcell.llm.memo import Generations, Memo
from weekcell.llm.registry import query, table
from weekcell.session import ensure_checkpoint_dir

BLOCK_IDS = 1024
SEGMENT_IDS = 1 << 16
PERCENTILE = 95
_HEAD = struct.Struct("<IBHH")

SEGMENT_SCHEMA = ("part int, segment long, first long, doc_ids array<bigint>, lengths array<bigint>, n_ids long, "
                  "block_starts array<bigint>, payload binary")


def pack_block(ids: np.ndarray) -> bytes:
    """One block: see the head of this file."""
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    cut = int(np.partition(rest, max(0, -(-len(rest) * PERCENTILE // 100) - 1))[max(0, -(-len(rest) * PERCENTILE // 100) - 1)])
    width = cut.bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = np.unpackbits(rest.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return (_HEAD.pack(low, width, len(odd), len(ids)) + np.packbits(bits.reshape(-1), bitorder="little").tobytes()
            + odd.astype("<u2").tobytes() + rest[odd].astype("<u4").tobytes())


def unpack_block(data: bytes, at: int) -> np.ndarray:
    low, width, n_odd, n = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    n_bytes = (n * width + 7) // 8
    bits = np.zeros((n, 32), dtype=np.uint8)
    if width:
        bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, n_bytes, at), bitorder="little")[:n * width].reshape(n, width)
    rest = np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4").copy()
    at += n_bytes
    if n_odd:
        rest[np.frombuffer(data, "<u2", n_odd, at)] = np.frombuffer(data, "<u4", n_odd, at + 2 * n_odd)
    return rest + np.uint32(low)


def pack(ids: np.ndarray) -> tuple[list[int], bytes]:
    """Block starts and payload of a segment."""
    starts, out, at = [], [], 0
    for k in range(0, len(ids), BLOCK_IDS):
        block = pack_block(ids[k:k + BLOCK_IDS])
        starts.append(at)
        out.append(block)
        at += len(block)
    return starts, b"".join(out)


def unpack(starts, payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """All ids of a segment, or those of blocks first to last - 1 (found by the index of starts)."""
    blocks = [unpack_block(payload, s) for s in starts[first:last]]
    return np.concatenate(blocks) if blocks else np.zeros(0, dtype=np.uint32)


#: A word that the vocabulary's normalizer and splitter leave in one piece.
_PLAIN = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")
#: ASCII marks that may follow it.
_MARKS = bytes(b for b in range(128) if not re.match("[\\w\\s']", chr(b), re.ASCII))


class WordEncoder:
    """Ids of whole texts by the tokenizers library, word by word.

    The vocabulary's normalizer and splitter drop white space and never look across it, so a text's ids are those of
    its ASCII-white-space separated words, in order; case of A-Z does not count. Nor do they look from a run of letters to
    the marks behind it, unless an apostrophe or a special token (both opened by other characters) is among
    them. So plain words and their marks are encoded apart, and each is remembered. Tested against whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
        hidden = [b for b in range(256) if b not in set(shown)]
        sign = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.signs = "".join(sign[b] for b in range(256))
        self.special = b"<|"
        self.words = Generations(self._word)
        self.marks = Memo(self._marks, limit=1 << 20)

    def _pack(self, ids) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, word: str) -> bytes:
        return self._pack(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _marks(self, marks: bytes) -> bytes:
        return self._whole(marks.decode("ascii"))

    def _letters(self, word: str) -> bytes:
        """A run of letters that need no normalizing but lower case (one for one in _PLAIN) goes straight to the library's merges."""
        signs = word if word.isascii() else codecs.charmap_decode(word.lower().encode("utf-8"), "strict", self.signs)[0]
        return self._pack([t.id for t in self.tokenizer.model.tokenize(signs)])

    def _word(self, word: bytes) -> bytes:
        """A word without its marks is remembered as the word that it is."""
        letters = word.rstrip(_MARKS)
        if letters.isalpha() or _PLAIN.fullmatch(letters.decode("utf-8")):  # of bytes, isalpha() holds for ASCII alone
            return self._letters(word.decode("utf-8")) if len(letters) == len(word) else self.words[letters] + self.marks[word[len(letters):]]
        return self._whole(word.decode("utf-8"))

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special in text:
            return b"".join(self._whole(w.decode("utf-8")) for w in text.split())
        return b"".join(map(self.words.__getitem__, text.lower().split()))


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """A worker's encoder; what it remembers serves all tasks of the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _segments(tokenizer: str, end_id: int):
    tail = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        docs, lengths, held, size, first = [], [], [], 0, 0

        def segment():
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            starts, payload = pack(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([first], pa.int64()),
                 pa.array([docs], pa.list_(pa.int64())),
                 pa.array([lengths], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()),
                 pa.array([starts], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                ["part", "segment", "first", "doc_ids", "lengths", "n_ids", "block_starts", "payload"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary())):
                ids = encoder.encode(text.as_py() or b"") + tail
                if held and size + len(ids) // 4 > SEGMENT_IDS:
                    yield segment()
                    number, first, docs, lengths, held, size = number + 1, first + size, [], [], [], 0
                docs.append(doc_id.as_py())
                lengths.append(len(ids) // 4)
                held.append(ids)
                size += len(ids) // 4
        if held:
            yield segment()
    return run


def write_token_table(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode ``text`` of every row and write segments under ``path`` in ascending doc_id order (nulls first).

    Rows are dealt by ranges of (doc_id, hash of the text, input partition), so that rows that share a doc_id can be
    split; a null text has no ids but its end id. A lost task is rerun over the same range.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.xxhash64("text").alias("h"), F.spark_partition_id().alias("p"))
    (keyed.repartitionByRange("doc_id", "h", "p").sortWithinPartitions("doc_id", "h")
     .select("doc_id", "text")
     .mapInArrow(_segments(tokenizer, end_id), SEGMENT_SCHEMA)
     .write.parquet(path))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = ([], [], [], [])
        for row in batch.to_pylist():
            ids = unpack(row["block_starts"], row["payload"]).astype("<u4")
            at = 0
            for doc_id, n in zip(row["doc_ids"], row["lengths"]):
                for column, value in zip(out, (doc_id, row["start"] + at, n, zlib.crc32(ids[at:at + n].tobytes()))):
                    column.append(value)
                at += n
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out],
                                         ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``, the number of ids in all segments before.

    Sums of whole parts are ordered in one small window and broadcast: a row for each task that wrote, nothing else.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    parts = (segments.groupBy("part").agg(F.sum("n_ids").alias("held"))
             .withColumn("before", F.sum("held").over(Window.orderBy("part")) - F.col("held")).select("part", "before"))
    return segments.join(F.broadcast(parts), "part").withColumn("start", F.col("before") + F.col("first")).drop("before")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    return (read_segments(spark, path).select("doc_ids", "lengths", "block_starts", "payload", "start")
            .mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long"))


@query("op7_token_files")
def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    write_token_table(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_documents(spark, path)
