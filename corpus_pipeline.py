"""From raw documents to token ids: five stages, each over all that the one before it kept.

    quality rules          documents that the rules of their language and source reject go
    line dedup             lines that stand in ten documents or more go, in all of them
    n-gram Jaccard join    of each group of near duplicates one document stays
    mixing                 sources are brought to their weights; rare ones come up to twice
    byte-level BPE         token ids of every document, decoded again for a check

A stage takes the documents that the stage before it wrote, and returns rows
with the same columns; the last one returns a row of results per document.
``run`` writes each stage's rows to the folder of ``spark.checkpoint.dir`` and
reads them again, so a lost executor costs no finished stage.

Rows without an id, source, language or text, repeated rows and empty tables go
through all stages, as the stages' operators say; other columns go along up to
the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, jaccard, lines, mixing, quality
from quire.llm.tables import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.with_kept_text(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, mixing.Target(max_repeats=2.0))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, vocabulary, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", near_duplicates),
    ("source mixing", source_mixing),
    ("byte-level bpe", byte_bpe),
]

# The first stage's thresholds come from quantile sketches, the last stage is no SQL:
# tests/llm/test_models.py holds every stage against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *filters, (_, last) = STAGES
    for name, stage in filters:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
