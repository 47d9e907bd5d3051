"""SentencePiece BPE by a table of prefixes.

The encoding of every prefix of a piece of text ends in exactly one last token, and dropping that token leaves the
encoding of a shorter prefix. So one pass from left to right stores for each prefix its last token: among the vocabulary
tokens that an Aho-Corasick automaton finds to end there, the one whose predecessor (the last token of the prefix
before it) is *compatible*, which is when merging the two tokens' characters alone gives just these two tokens again.
Following the table backwards from the end yields the ids.

Three facts about a vocabulary allow cutting a text before that; they are checked when it is loaded: no token has
a space mark after another character, none has a line feed, and every character of a token is itself a token.
"""

from __future__ import annotations

import hashlib
import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcell.llm.memo import Memo
from weekcell.llm.registry import query, table

SPACE = "▁"  # stands for a space in the vocabulary
_NEVER = float("-inf")
_ODD = (-1, -1)
_LETTERS = string.ascii_letters + "".join(map(chr, range(0xC0, 0x100)))


class PieceTable:
    """Encoder and decoder of one vocabulary; built once in each Python worker."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids, self.scores, self.text, self.byte_ids = {}, [], [], {}
        self.byte_of: dict[int, int] = {}
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            self.scores.append(model.get_score(k))
            self.text.append(piece)
            if model.is_byte(k):
                self.byte_ids[int(piece[3:-1], 16)] = k
                self.byte_of[k] = int(piece[3:-1], 16)
            elif not (model.is_control(k) or model.is_unknown(k)):
                self.ids[piece] = k
        chars = {c for piece in self.ids for c in piece}
        if len(self.byte_ids) != 256 or any(c not in self.ids for c in chars):
            raise ValueError("the vocabulary must have all bytes, and each character of a token as a token")
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids) or "\n" in chars:
            raise ValueError("a space mark may only open a token, and no token may hold a line feed")
        self.automaton = ahocorasick.Automaton()
        for piece, k in self.ids.items():
            self.automaton.add_word(piece, (k, len(piece)))
        self.automaton.make_automaton()
        # characters that no token has right behind a Latin letter: a run of letters ends there for certain
        inside = {piece[k:k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        self.stops = "".join(c for c in string.punctuation if not any(x + c in inside for x in _LETTERS))
        self.pattern = re.compile(rf"{SPACE}*[{_LETTERS}]+(?=[{re.escape(self.stops)}])|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.origins = Memo(self._origin, limit=1 << 40, longest=1 << 30)  # as many as there are tokens
        self.pairs = Memo(self._compatible, longest=2)
        self.alone = Memo(lambda k: self._merge(self.text[k[0]]) == [self.text[k[0]]], longest=1)

    def _merge(self, text: str, stop: int = -1) -> list[str]:
        """Merge neighbours by best score, leftmost first: the definition, for the few characters of two tokens.

        With ``stop``, the state before the merge that makes this token of the whole text.
        """
        parts, ids, scores = list(text), self.ids, self.scores

        def worth(k: int) -> float:
            token = ids.get(parts[k] + parts[k + 1])
            return _NEVER if token is None else scores[token]

        gain = [worth(k) for k in range(len(parts) - 1)]
        while gain:
            best = max(gain)
            if best == _NEVER:
                break
            k = gain.index(best)
            if len(parts) == 2 and stop == ids[parts[0] + parts[1]]:
                break
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del gain[k]
            if k < len(gain):
                gain[k] = worth(k)
            if k:
                gain[k - 1] = worth(k - 1)
        return parts

    def _origin(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made ``token`` (None: a character); _ODD if it isn't the latest of the merges within."""
        text = self.text[token]
        if len(text) == 1:
            return None
        ends = [0]
        for part in self._merge(text, stop=token):
            ends.append(ends[-1] + len(part))
        if len(ends) != 3:
            return _ODD
        halves = self.ids[text[:ends[1]]], self.ids[text[ends[1]:]]
        for half in halves:
            inner = self.origins[half]
            if inner is _ODD or inner is not None and self.scores[half] <= self.scores[token]:
                return _ODD
        return halves

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether the two tokens stay apart when their characters are merged.

        Going back in time from the last merge, each pair that met at the border must not have been a better merge
        than the one that changed the border next (of equal ones the left one comes first).
        """
        left, right = pair
        if self.origins[left] is _ODD or self.origins[right] is _ODD:
            texts = [self.text[left], self.text[right]]
            return self._merge("".join(texts)) == texts
        ids, text, scores, origins = self.ids, self.text, self.scores, self.origins
        least, or_equal = _NEVER, False
        while True:
            joined = ids.get(text[left] + text[right])
            if joined is not None and (scores[joined] > least or or_equal and scores[joined] == least):
                return False
            of_left, of_right = origins[left], origins[right]
            if of_left is not None and (of_right is None or scores[left] < scores[right]):
                least, or_equal, left = scores[left], False, of_left[1]
            elif of_right is not None:
                least, or_equal, right = scores[right], True, of_right[0]
            else:
                return True

    def _known(self, run: str) -> list[int]:
        """Ids of a run of characters that are all in the vocabulary."""
        n = len(run)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        pairs, alone = self.pairs, self.alone
        for end, (token, length) in self.automaton.iter(run):
            start = end + 1 - length
            if last[end + 1] >= 0:
                continue
            if alone[(token,)] if start == 0 else last[start] >= 0 and pairs[(last[start], token)]:
                last[end + 1], size[end + 1] = token, length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def cut(self, text: str) -> list[str]:
        """The text with its opening space, marked and cut where no token can reach across."""
        return self.pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a piece of text; characters outside the vocabulary part it and become bytes."""
        if all(c in self.ids for c in piece):
            return self._known(piece) if piece else []
        out, run = [], []
        for c in piece:
            if c in self.ids:
                run.append(c)
                continue
            out += self._known("".join(run)) if run else []
            out += [self.byte_ids[b] for b in c.encode("utf-8")]
            run = []
        return out + (self._known("".join(run)) if run else [])

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, the first space goes, bytes are joined to UTF-8 (or U+FFFD for each bad byte)."""
        pieces = self.text
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([pieces[k] for k in ids]).replace(SPACE, " ").removeprefix(" ")
        out, run = [], bytearray()
        for k in [*ids, -1]:
            if k in self.byte_of:
                run.append(self.byte_of[k])
                continue
            out.append(_text_of(run))
            run.clear()
            if k >= 0:
                out.append(pieces[k].replace(SPACE, " "))
        text = "".join(out)
        return text[1:] if pieces[ids[0]].startswith(SPACE) else text


def _text_of(data: bytearray) -> str:
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at:at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            at += 1
    return "".join(out)


_TABLES: dict[str, tuple[PieceTable, Memo]] = {}


def _table(model_file: str) -> tuple[PieceTable, Memo]:
    """The worker's table, and a memo of cut pieces: number of ids, ids as text, decoded text."""
    if model_file not in _TABLES:
        pieces = PieceTable(model_file)

        def compute(piece: str):
            ids = pieces.encode_piece(piece)
            # a mark before the piece keeps its own spaces: decode() drops one space at the start of a text only
            text = pieces.decode([pieces.ids[SPACE], *ids])
            return len(ids), ",".join(map(str, ids)), text
        _TABLES[model_file] = pieces, Memo(compute, limit=96 << 20)
    return _TABLES[model_file]


_IDS: dict[str, tuple[PieceTable, Memo]] = {}


def _ids(model_file: str) -> tuple[PieceTable, Memo]:
    """The worker's table, and a memo of the ids of cut pieces as 32-bit integers; digests and decoded texts are not held beside them."""
    if model_file not in _IDS:
        pieces = PieceTable(model_file)
        _IDS[model_file] = pieces, Memo(lambda piece: array("i", pieces.encode_piece(piece)).tobytes(), limit=64 << 20)
    return _IDS[model_file]


def encode(text: str, model_file: str) -> list[int]:
    pieces, _ = _table(model_file)
    return [k for piece in pieces.cut(text) for k in pieces.encode_piece(piece)]


def _digests(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, memo = _table(model_file)
        for batch in batches:
            n_tokens, ids_sha, text_sha = [], [], []
            for value in batch.column("text"):
                found = list(map(memo.__getitem__, pieces.cut(value.as_py() or "")))
                n_tokens.append(sum(x[0] for x in found))
                ids_sha.append(hashlib.sha256(",".join([x[1] for x in found]).encode()).hexdigest())
                decoded = "".join([x[2] for x in found])
                text_sha.append(hashlib.sha256(decoded[1:].encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _encoded(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, memo = _ids(model_file)
        for batch in batches:
            found = [[memo[p] for p in pieces.cut(x.as_py() or "")] for x in batch.column("__text")]
            data = [b"".join(x) for x in found]
            offsets = np.cumsum([0] + [len(x) // 4 for x in data])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(data), np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "__text"), lists],
                                             [*(c for c in batch.schema.names if c != "__text"), "ids"])
    return run


def with_ids(docs: DataFrame, model_file: str) -> DataFrame:
    """``docs`` with the column ``ids`` (one of that name is replaced). A null or empty text has no ids."""
    docs = docs.drop("ids")
    return docs.withColumn("__text", F.col("text").cast("string")).mapInArrow(
        _encoded(model_file), T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def piece_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts (null: empty), a row for each row of ``docs``."""
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInArrow(
        _digests(model_file), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op8_pieces")
def op8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
