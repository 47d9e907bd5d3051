"""From raw documents to token ids: drop toxic and poor documents, near copies and test items, then encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``docs``. A stage's result
is written before the next one reads it, so that a lost executor costs no more than its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcell.llm.components import written
from weekcell.llm.decontamination import without_items
from weekcell.llm.ngram_join import one_of_each_group
from weekcell.llm.pieces import with_ids
from weekcell.llm.quality import keep_good
from weekcell.llm.registry import table
from weekcell.llm.toxicity import fit_toxicity, score_toxicity, training_rows

PIECES = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.5, by a model of the labelled ones."""
    model = fit_toxicity(training_rows(docs, table(spark, sf_dir, "labels")))
    scored = score_toxicity(docs.withColumnRenamed("toxicity", "__toxicity"), model)
    return scored.filter(F.col("toxicity") < 0.5).drop("toxicity").withColumnRenamed("__toxicity", "toxicity")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose histograms are near those of a language."""
    return keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    return one_of_each_group(docs, n=5, percent=80)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of the five-word shingles of any benchmark item."""
    return without_items(docs, table(spark, sf_dir, "benchmark"), n=5, percent=80)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the number of ids and the ids of each document."""
    import public_tokenizers

    with_all = with_ids(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path(PIECES))
    return with_all.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_poor), ("n-gram Jaccard join", drop_near_copies),
          ("benchmark decontamination", drop_test_items), ("SentencePiece encoding", encode)]

#: No SQL: the toxicity model is trained. The tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
