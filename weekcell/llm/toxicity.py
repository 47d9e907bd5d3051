"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in the words it holds; a document's score is the
noisy-or of its sentences, 1 - prod(1 - p), and of one prior. A sentence without any feature adds nothing, so that length alone is no
offence. Only documents have labels, yet training the two together gives sentence scores
that say where the document offends.

The model is learned from a bounded sample of the labels (MAX_LABELS). Features are hashes of a word and of its first bytes
(so that inflected forms share features). Which of them count is found from document counts by label, added up by Spark. The
weights are then fitted to at most MAX_FIT_ROWS of these documents, held as lists of selected features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcell.llm.components import written
from weekcell.llm.registry import query, table
from weekcell.llm.words import mix, span_hashes, text_bytes, text_chunks

#: Features that the model may use, labels that it is learned from (features' counts), and rows of these that its weights are fitted to.
MAX_FEATURES = 4096
MAX_LABELS = 60_000
MAX_FIT_ROWS = 20_000
#: A feature must be in so many toxic documents.
LEAST_DOCUMENTS = 3
#: Lengths in bytes of the openings of a word.
OPENINGS = (4, 5, 6, 7, 8)
#: Buckets of the hash that picks labels.
_BUCKETS = 1 << 32

_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
_WORD[48:58] = True
_WORD[97:123] = True
_END = np.zeros(256, dtype=bool)
_END[[10, 33, 46, 63]] = True  # line feed ! . ?


@dataclass
class ToxicityModel:
    """Sorted feature hashes, their weights, and log-odds: bias of a sentence, score of a sentence without any feature (None: the
    bias), prior of a document that has a sentence."""
    features: np.ndarray
    weights: np.ndarray
    bias: float
    plain: float | None = None
    prior: float = -np.inf

    @property
    def plain_score(self) -> float:
        return self.bias if self.plain is None else self.plain


def _found(column: pa.Array, low: int, high: int):
    """Of rows low..high: bytes, offsets, sentence of each word (counted through the chunk), words' starts, features."""
    data, offsets = text_bytes(column, low, high)
    n = len(data) - 8
    solid = _WORD[data[:n]]
    ends = _END[data[:n]]
    ends[np.maximum(offsets[1:] - 1, 0)[np.diff(offsets) > 0]] = True  # a row's last byte ends its sentence
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.concatenate([[False], solid]), np.concatenate([solid, [False]])
    starts = np.flatnonzero(after & (~before | edge))
    lengths = np.flatnonzero(before & (~after | edge)) - starts
    sentence = np.cumsum(ends, dtype=np.int64) - ends  # by byte: sentences ended before it
    return data, offsets, sentence, starts, lengths, ends


def _features(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indexes of words, hashes): the whole word, then each opening that is shorter than the word."""
    out = [(np.arange(len(starts)), span_hashes(data, starts, lengths))]
    for k in OPENINGS:
        longer = np.flatnonzero(lengths > k)
        out.append((longer, mix(span_hashes(data, starts[longer], np.full(len(longer), k)) + np.uint64(k))))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic documents, clean documents) of some rows; each batch is folded before it leaves."""
    for batch in batches:
        column, toxic = batch.column("text"), np.asarray(batch.column("toxic"))
        for low, high in text_chunks(column):
            data, offsets, _, starts, lengths, _ = _found(column, low, high)
            row = np.searchsorted(offsets, starts, side="right") - 1
            hashes, rows = (np.concatenate(x) for x in zip(*[(h, row[k]) for k, h in _features(data, starts, lengths)]))
            order = np.lexsort((rows, hashes))
            hashes, rows = hashes[order], rows[order]
            first = np.ones(len(hashes), dtype=bool)
            first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
            hashes, rows = hashes[first], rows[first]
            values, at = np.unique(hashes, return_index=True)
            if not len(values):
                continue
            bad = np.add.reduceat(toxic[low + rows].astype(np.int64), at)
            total = np.diff(np.concatenate([at, [len(hashes)]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(values.view(np.int64)), pa.array(bad), pa.array(total - bad)], ["feature", "bad", "good"])


def _bags(features: np.ndarray):
    """Per row: selected features of each sentence that has one (as places in ``features``), and all its sentences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            bags, sizes = [], []
            for low, high in text_chunks(column):
                for sentence, place, n, *_ in _rows(features, column, low, high):
                    bags.append(np.stack([sentence, place], axis=1).reshape(-1).astype(np.int32))
                    sizes.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(bags, pa.list_(pa.int32())), pa.array(sizes, pa.int64())],
                ["toxic", "bag", "sentences"])
    return run


def _rows(features: np.ndarray, column: pa.Array, low: int, high: int):
    """For each row: (sentence, place) of its selected features, sorted and distinct; number of sentences; their ends."""
    data, offsets, sentence, starts, lengths, ends = _found(column, low, high)
    pairs = []
    for k, h in _features(data, starts, lengths):
        place = np.searchsorted(features, h)
        place[place == len(features)] = 0
        hit = features[place] == h if len(features) else np.zeros(len(h), dtype=bool)
        pairs.append((sentence[starts[k[hit]]], place[hit], starts[k[hit]]))
    s, f, at = (np.concatenate(x) for x in zip(*pairs))
    order = np.lexsort((f, s))
    s, f, at = s[order], f[order], at[order]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != s[:-1]) | (f[1:] != f[:-1])
    s, f, at = s[keep], f[keep], at[keep]
    total = np.concatenate([[0], np.cumsum(ends)])
    begin, stop = total[offsets[:-1]], total[offsets[1:]]
    cut = np.searchsorted(s, np.concatenate([begin, stop[-1:]]))
    for r in range(high - low):
        part = slice(cut[r], cut[r + 1])
        yield s[part] - begin[r], f[part], int(stop[r] - begin[r]), ends, offsets[r], offsets[r + 1]


def _softplus(z):
    return np.logaddexp(0.0, z)


def fit_bags(toxic: np.ndarray, bags: list[np.ndarray], sentences: np.ndarray, n_features: int,
             steps: int = 300, rate: float = 0.1, decay: float = 2e-3) -> tuple[np.ndarray, float, float]:
    """Weights, bias and prior that maximize the documents' likelihood under noisy-or, by Adam over the whole sample.

    Sentences without features add nothing; a document with any sentence has the prior.
    """
    doc = np.repeat(np.arange(len(bags)), [len(b) // 2 for b in bags])
    flat = np.concatenate([np.asarray(b, dtype=np.int64) for b in bags]) if bags else np.zeros(0, np.int64)
    inner, place = flat[0::2], flat[1::2]
    edge = np.ones(len(doc), dtype=bool)
    edge[1:] = (doc[1:] != doc[:-1]) | (inner[1:] != inner[:-1])
    sid = np.cumsum(edge) - 1
    owner = doc[edge]
    some = (sentences > 0).astype(float)
    w, b, c = np.zeros(n_features), -4.0, -4.0
    m, v = np.zeros(n_features + 2), np.zeros(n_features + 2)
    for t in range(1, steps + 1):
        z = b + np.bincount(sid, weights=w[place], minlength=len(owner))
        q = np.bincount(owner, weights=_softplus(z), minlength=len(toxic)) + some * _softplus(c)
        pull = np.where(toxic == 1, -1.0 / np.expm1(np.maximum(q, 1e-9)), 1.0) / len(toxic)
        slope = pull[owner] / (1 + np.exp(-z))
        grad = np.append(np.bincount(place, weights=slope[sid], minlength=n_features) + decay * w / max(1, n_features) ** 0.5,
                         [slope.sum(), (pull * some).sum() / (1 + np.exp(-c))])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w, b, c = w - step[:-2], b - step[-2], c - step[-1]
    return w, float(b), float(c)


def fit_toxicity(labelled: DataFrame) -> ToxicityModel:
    """A model from rows (doc_id, text, toxic); rows without a label are left out, a null text is empty.

    Feature counts come from all rows; weights from the MAX_FIT_ROWS rows with the smallest hash of doc_id and text, as small
    integer lists. Without labels, or with clean ones only, every document gets the same low score; with toxic ones only,
    every sentence the same high one.
    """
    rows = labelled.filter("toxic IN (0, 1)").selectExpr("cast(doc_id AS long) AS doc_id", "coalesce(cast(text AS string), '') AS text",
                                                         "cast(toxic AS int) AS toxic")
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        none = np.zeros(0, np.uint64), np.zeros(0)
        return ToxicityModel(*none, 4.0) if bad else ToxicityModel(*none, -8.0, -np.inf, -8.0)
    rate_bad, rate_good = (F.col("bad") + 0.5) / (bad + 1.0), (F.col("good") + 0.5) / (good + 1.0)
    chosen = (rows.select("text", "toxic").mapInArrow(_count, "feature long, bad long, good long")
              .groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
              .filter(F.col("bad") >= LEAST_DOCUMENTS).filter(rate_bad > 3.0 * rate_good)
              .withColumn("worth", F.col("bad") * F.log(rate_bad / rate_good))
              .orderBy(F.desc("worth"), "feature").limit(MAX_FEATURES).select("feature").toPandas())
    features = np.sort(chosen["feature"].to_numpy(dtype=np.int64).view(np.uint64))
    # the sample's limit is found from hashes alone, so that no text moves; equal rows may share the last hash
    h = F.xxhash64("doc_id", "text")
    last = rows.select(h.alias("h")).orderBy("h").limit(MAX_FIT_ROWS).agg(F.max("h")).first()[0]
    sample = rows.filter(h <= F.lit(last))
    got = sample.select("text", "toxic").mapInArrow(_bags(features), "toxic int, bag array<int>, sentences long").limit(MAX_FIT_ROWS).toPandas()
    w, b, c = fit_bags(got["toxic"].to_numpy(), list(got["bag"]), got["sentences"].to_numpy(), len(features))
    return ToxicityModel(features, w, b, -np.inf, c)


def _score(model: ToxicityModel, keep: list[str]):
    weights = np.append(model.weights, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, scores = batch.column("__text"), []
            for low, high in text_chunks(column):
                for sentence, place, n, *_ in _rows(model.features, column, low, high):
                    with_some, at = np.unique(sentence, return_index=True)
                    z = model.bias + (np.add.reduceat(weights[place], at) if len(at) else np.zeros(0))
                    q = _softplus(z).sum() + max(n - len(with_some), 0) * _softplus(model.plain_score)
                    q += _softplus(model.prior) if n else 0.0
                    scores.append(-np.expm1(-q))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())],
                                             [*keep, "toxicity"])
    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1; a column of that name is replaced). A null or empty text has no sentence and scores 0."""
    from pyspark.sql import types as T

    docs = docs.drop("toxicity")
    return docs.withColumn("__text", F.col("text").cast("string")).mapInArrow(
        _score(model, docs.columns), T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())]))


def offending_sentences(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """doc_id, start, length (bytes of UTF-8), score of every sentence with a score of at least ``least``."""
    weights = np.append(model.weights, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, out, row = batch.column("text"), ([], [], [], []), 0
            for low, high in text_chunks(column):
                for sentence, place, n, ends, begin, stop in _rows(model.features, column, low, high):
                    z = np.where(np.bincount(sentence, minlength=n) > 0,
                                 model.bias + np.bincount(sentence, weights=weights[place], minlength=n), model.plain_score)
                    p = 1 / (1 + np.exp(-z))
                    stops = np.flatnonzero(ends[begin:stop]) + 1
                    starts = np.concatenate([[0], stops[:-1]])
                    for k in np.flatnonzero(p[:n] >= least):
                        for column_out, value in zip(out, (batch.column("doc_id")[row].as_py(), int(starts[k]), int(stops[k] - starts[k]), float(p[k]))):
                            column_out.append(value)
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                                              pa.array(out[3], pa.float64())], ["doc_id", "start", "length", "score"])
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInArrow(
        run, "doc_id long, start long, length long, score double")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.crc32(doc_id.cast("string")) % F.lit(folds) == F.lit(fold)


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> DataFrame:
    """doc_id, text, toxic of labelled documents outside the held-out fold, as a written table (a null doc_id has no label).

    Of more than ``most`` labels, those with a hash of doc_id under a limit are taken (``most`` on average; repeated labels count once),
    so that the labels can be broadcast and no text moves. A document with both labels counts as one of each.
    """
    known = (labels.filter("toxic IN (0, 1)").selectExpr("cast(doc_id AS long) AS doc_id", "cast(toxic AS int) AS toxic")
             .filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)).distinct())
    limit = int(_BUCKETS * min(1.0, most / max(1, known.count())))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(_BUCKETS)) < limit)
    return written(docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").join(F.broadcast(chosen), "doc_id"),
                   "labelled")


def corpus_model(spark: SparkSession, folder: str) -> ToxicityModel:
    return fit_toxicity(training_rows(table(spark, folder, "documents"), table(spark, folder, "labels")))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_toxicity(table(spark, folder, "documents").select("doc_id", "text"), corpus_model(spark, folder))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id"), 5, 0), F.lit(False)).alias("held_out"),
                         F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
