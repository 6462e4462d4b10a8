"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet to the shared folder
and reads it again as the next stage's documents, so a lost executor costs one stage at most. All stages but the last
return the columns of the documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetally.lineage import shared_folder
from codetally.llm import decontaminate, language_id, packing, pii, simhash
from codetally.llm.shared import documents, unused

#: A document is rejected if its language can't be told, or is less likely than this.
LEAST_SCORE = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    model = language_id.fit(docs.filter(~language_id.held_out()))
    name = unused(docs, "language")
    found = language_id.identify(docs, model, out_col=name)
    told = (F.col(name)["lang"] != language_id.UNDETERMINED) & (F.col(name)["score"] >= LEAST_SCORE)
    return found.filter(told).select(docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name = unused(docs, "found")
    found = decontaminate.find_benchmark_text(docs, benchmark, out_col=name)
    return found.filter(F.size(F.col(name)["spans"]) == 0).select(docs.columns)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and the words that give it away, replaced."""
    base, spans, clean = (unused(docs, name) for name in ("base", "spans", "clean"))
    found = pii.find_personal_data(docs, base_col=base, spans_col=spans)
    found = found.withColumn(clean, pii.sanitised(F.col("text"), F.col(spans)))
    columns = {c: F.col(c) for c in docs.columns} | {"text": F.col(clean)}
    if "n_chars" in columns:
        size = F.length(clean).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.size(spans) > 0, size).otherwise(F.col("n_chars"))
    return found.select(*(column.alias(name) for name, column in columns.items()))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as packed pieces."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("language_id", identified),
    ("simhash_near_dedup", deduplicated),
    ("benchmark_decontamination", decontaminated),
    ("pii", sanitised),
    ("best_fit_packing", packed),
]

#: Tokenization and a fitted model are beyond SQL; the tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
