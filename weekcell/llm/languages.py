"""Language identification by bit-sliced Bloom filters.

All languages share one table of ``ROWS`` rows; each row holds one bit per language. An n-gram (bytes within lower-cased
letters, a space at either end of a word) points to PROBES rows, and the AND of these rows is the set of languages that hold it. A
document's popcount per language, less the hits that a filter of that fill gives by chance, over its n-grams, is the share of
its n-grams that the language holds; the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcell.llm.registry import query, table
from weekcell.llm.toxicity import held_out
from weekcell.llm.words import mix, offsets_of, text_chunks

#: Rows of the table (a power of two): with 64 languages it takes 8 MB, whatever the corpus holds.
ROWS = 1 << 20
PROBES = 3
#: Lengths of the n-grams in bytes.
GRAMS = (3, 5)
#: A language holds an n-gram that is in this share of its documents, in two of them at least, and in no less than
#: a tenth of the share of any other language.
LEAST_SHARE = 0.002
LEAST_DOCUMENTS = 2
LEAST_OF_BEST = 0.1

_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_LETTER[_LETTER == 0] = 32


@dataclass
class LanguageFilters:
    """Languages in sorted order and the table: uint64 words of ROWS x ceil(languages / 64)."""
    languages: list[str]
    table: np.ndarray

    def by_chance(self) -> np.ndarray:
        """Per language: the chance that an n-gram it doesn't hold is found all the same."""
        return np.array([np.mean((self.table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)) ** PROBES
                         for k in range(len(self.languages))])


def has_letter(text) -> F.Column:
    return F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}")


def _words(column: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and number of every word (a run without ASCII white space) of some rows, and the distinct words by number."""
    lists = pc.ascii_split_whitespace(column.slice(low, high - low).fill_null(""))
    words = lists.flatten().dictionary_encode()
    rows = np.repeat(np.arange(high - low), np.diff(np.asarray(lists.offsets)))
    return rows, np.asarray(words.indices).astype(np.int64), words.dictionary


def _grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of the word and hash of every n-gram that has a letter and no space within (only at its ends); a space stands at either end of a word."""
    part = pc.utf8_lower(words)
    offsets = offsets_of(part)
    data = part.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    # a space before and after each word
    out = np.full(len(raw) + len(part) + 1 + 8, 32, dtype=np.uint8)
    row = np.repeat(np.arange(len(part)), np.diff(offsets))
    out[np.arange(len(raw)) + row + 1] = _LETTER[raw]
    owner = np.full(len(out), -1, dtype=np.int64)
    owner[np.arange(len(raw)) + row + 1] = row
    eights = np.ndarray(shape=(len(out) - 7,), dtype="<u8", buffer=out.data, strides=(1,))
    space = out == 32
    rows, hashes = [], []
    for n in GRAMS:
        size = max(0, len(eights) - n)
        inner = np.ones(size, dtype=bool)
        for k in range(1, n - 1):
            inner &= ~space[k:k + size]
        at = np.flatnonzero(inner)
        rows.append(owner[at + 1])
        hashes.append(mix((eights[at] & np.uint64((1 << (8 * n)) - 1)) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(hashes)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([np.ones(min(len(values), 1), dtype=bool), values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values)))


def _grams_by_row(rows: np.ndarray, codes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of the n-gram), once for each row, and the n-grams by number. A word that a row repeats is expanded once."""
    word, hashes = _grams(words)
    order = np.argsort(word, kind="stable")
    known = pa.array(hashes[order]).dictionary_encode()
    number, grams = np.asarray(known.indices).astype(np.int64), np.asarray(known.dictionary)
    first = np.searchsorted(word[order], np.arange(len(words) + 1))
    rows, codes = np.divmod(_distinct(rows * len(words) + codes)[0], max(len(words), 1))
    n = first[codes + 1] - first[codes]
    at = np.repeat(first[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    rows, number = np.divmod(_distinct(np.repeat(rows, n) * len(grams) + number[at])[0], max(len(grams), 1))
    return rows, number, grams


def _count(languages: list[str]):
    """(language, n-gram, documents) of some rows."""
    places = {x: k for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            lang = np.array([places[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for low, high in text_chunks(column):
                rows, number, grams = _grams_by_row(*_words(column, low, high))
                found, documents = _distinct(lang[low + rows] * len(grams) + number)
                which, number = np.divmod(found, max(len(grams), 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(which.astype(np.int32)), pa.array(grams[number].view(np.int64)), pa.array(documents)], ["language", "gram", "documents"])
    return run


def _probes(hashes: np.ndarray) -> list[np.ndarray]:
    return [((hashes >> np.uint64(20 * k)) & np.uint64(ROWS - 1)).astype(np.int64) for k in range(PROBES)]


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        language = np.asarray(batch.column("language")).astype(np.int64)
        rows = np.concatenate(_probes(np.asarray(batch.column("gram")).view(np.uint64)))
        word, bit = np.tile(language // 64, PROBES), np.tile(np.uint64(1) << (language % 64).astype(np.uint64), PROBES)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(word), pa.array(bit.view(np.int64))], ["row", "word", "bits"])


def fit_languages(docs: DataFrame) -> LanguageFilters:
    """Filters from all rows with a language (columns text, lang); a null text adds nothing.

    What reaches the driver is the list of languages and at most ROWS rows of the table for each 64 languages.
    """
    known = docs.filter(F.col("lang").isNotNull()).selectExpr("cast(lang AS string) AS lang", "coalesce(cast(text AS string), '') AS text")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    out = np.zeros((ROWS, max(1, -(-len(languages) // 64))), dtype=np.uint64)
    if not languages:
        return LanguageFilters(languages, out)
    total = F.element_at(F.array(*[F.lit(float(sizes[x])) for x in languages]), F.col("language") + 1)
    grams = (known.mapInArrow(_count(languages), "language int, gram long, documents long")
             .groupBy("gram", "language").agg(F.sum("documents").alias("documents"))
             .withColumn("share", F.col("documents") / total)
             .withColumn("best", F.max("share").over(Window.partitionBy("gram")))
             .filter((F.col("documents") >= F.least(F.lit(LEAST_DOCUMENTS), total)) & (F.col("share") >= LEAST_SHARE)
                     & (F.col("share") >= LEAST_OF_BEST * F.col("best")))
             .select("language", "gram"))
    table_rows = (grams.mapInArrow(_bits, "row long, word long, bits long")
                  .groupBy("row", "word").agg(F.bit_or("bits").alias("bits")).toArrow())
    out[table_rows["row"].to_numpy(), table_rows["word"].to_numpy()] = table_rows["bits"].to_numpy().view(np.uint64)
    return LanguageFilters(languages, out)


def _decide(filters: LanguageFilters, text: str, keep: list[str], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, chance = shared.value
        n_languages = len(chance)
        for batch in batches:
            column = batch.column(text)
            labels, scores = [], []
            for low, high in text_chunks(column):
                rows, codes, words = _words(column, low, high)
                word, hashes = _grams(words)
                size = np.bincount(word, minlength=len(words))
                total = np.bincount(rows, weights=size[codes], minlength=high - low)
                hits = np.zeros((high - low, n_languages))
                probes = _probes(hashes)
                for w in range(tables.shape[1]):
                    mask = tables[probes[0], w]
                    for p in probes[1:]:
                        mask &= tables[p, w]
                    for k in range(64 * w, min(n_languages, 64 * w + 64)):
                        hit = np.bincount(word, weights=(mask >> np.uint64(k % 64)) & np.uint64(1), minlength=len(words))
                        hits[:, k] = np.bincount(rows, weights=hit[codes], minlength=high - low)
                if n_languages:
                    share = np.clip((hits / np.maximum(total, 1)[:, None] - chance) / np.maximum(1 - chance, 1e-9), 0, 1)
                    best, sums = share.argmax(axis=1), share.sum(axis=1)
                    labels += [filters.languages[b] if len(filters.languages) else None for b in best]
                    scores += list(np.where(sums > 0, share[np.arange(len(best)), best] / np.where(sums > 0, sums, 1), 0.0))
                else:
                    labels += [None] * (high - low)
                    scores += [0.0] * (high - low)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                                             [*keep, "lang_pred", "lang_score"])
    return run


def identify(docs: DataFrame, filters: LanguageFilters, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``lang_pred`` and ``lang_score`` (columns of those names are replaced).

    A text that is null or has no letter is ``und`` with score 0, as is every text when no language was learned. Equal shares go to the first
    language in sorted order. The score is the winner's part of the sum of all languages' shares.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "lang_score")]
    shared = docs.sparkSession.sparkContext.broadcast((filters.table, filters.by_chance()))
    small = LanguageFilters(filters.languages, filters.table[:0])
    asked = docs.select(*kept, F.col(text).cast("string").alias("__text"), has_letter(text).alias("__letter"))
    schema = T.StructType([*asked.drop("__text").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    found = asked.mapInArrow(_decide(small, "__text", [*kept, "__letter"], shared), schema)
    known = F.col("__letter") & F.col("lang_pred").isNotNull()
    return found.select(*kept, F.when(known, F.col("lang_pred")).otherwise("und").alias("lang_pred"),
                        F.when(known, F.col("lang_score")).otherwise(0.0).alias("lang_score"))


@query("op5_languages")
def op5_languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = F.coalesce(held_out(F.col("doc_id"), 3, 1), F.lit(False))
    filters = fit_languages(docs.filter(~out))
    return (identify(docs.select("doc_id", "text"), filters, keep=["doc_id"])
            .select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score")))
