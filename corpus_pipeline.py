"""The training-data pipeline: language ID, quality rules, near-duplicate
removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes each stage's result to the shared scratch folder and
reads it back as the next one's documents.  All stages but the last return the
columns of documents.

Null, empty and letterless texts go at the first stage, texts under 50 words at
the second.  Very long texts are worked through whole, by one task each.  Of
repeated rows and of near copies one stays, the smallest doc_id (null doc_ids
count as the largest).  Null languages and sources are groups of their own;
ties are settled by doc_id.  An empty table (or one that a stage empties) gives
no rows.  Columns besides those of documents are left out, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.llm import decontam, jaccard, langid, packing, quality
from triage.llm.common import bounded_batches, saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose likeliest language has less probability than this is rejected.
MIN_LANGUAGE_SCORE = 0.5
NEAR_DUPLICATE_WORDS, NEAR_DUPLICATE_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts of no clear language."""
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    judged = langid.predict(docs, langid.train(docs), COLUMNS)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that fail the base rules or lie far from their language and source."""
    bounded_batches(spark)
    return quality.judged(docs.select(*COLUMNS), COLUMNS, keep_text=True).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones."""
    bounded_batches(spark)
    join = jaccard.Jaccard(NEAR_DUPLICATE_WORDS, NEAR_DUPLICATE_PERCENT)
    return join.representatives(docs.select(*COLUMNS), COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    bounded_batches(spark)
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their place in a sequence."""
    bounded_batches(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The stages hold trained and sampled models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
