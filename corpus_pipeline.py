"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Columns beside those of `documents` pass all stages but the last unchanged, whatever their names. An empty table passes as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import line_dedup, mixing, quality_classifier, sentencepiece_ops, simhash
from tamarack.llm.common import delete, discard, shared_dir, written
from tamarack.session import table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents (score under 0.3) go; the model learns from the labels of `documents`. Null and empty
    texts have the prior for a score (they stay where most labels are good); repeated rows share their score."""
    model = quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages keep their first occurrence; documents that had nothing else go. n_chars follows the text. Null,
    empty and blank texts have no passage and stay; rows that repeat id and text are one document."""
    removed = "n_lines_removed"
    while removed in docs.columns:
        removed += "_"
    out = line_dedup.line_dedup(docs, drop_emptied=True, count=removed)
    n_chars = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select(*(n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays (null doc_ids all do)."""
    return simhash.keep_one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by probabilities raked to source, language and topic marginals. Null categories are one of their own;
    texts without a word are drawn like the rest of their source and language; repeated rows share their draw."""
    return mixing.mixed_rows(docs, budget=0.8)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document, the likelier draw first: their ids, log-probabilities and inclusion
    scores, and whether both decode to the text. A null text has nulls; a text with one segmentation has it alone. Rows that repeat id
    and text have the same segmentations."""
    # fewer lattices are kept than in the operator itself: executors still hold what the stages before have taken
    out = sentencepiece_ops.sample_encode(docs, sentencepiece_ops.Vocabulary.load(), k=2, most_nodes=300_000)
    sizes = F.transform("ids", lambda x: F.size(x).cast("long"))
    return out.select("doc_id", "ids", sizes.alias("n_pieces"), "log_p", "log_inclusion", "round_trip")


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_near),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Learnt and sampled stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's tables go once the next stage's input is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path, mark = f"{shared_dir(spark)}/stage-{name.replace(' ', '-')}-{uuid.uuid4().hex}", written()
        stage(spark, docs, sf_dir).write.parquet(path)
        discard(spark, mark)
        if last:
            delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
