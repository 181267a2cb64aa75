"""From raw documents to mixed, encoded training data.

Each stage takes what its predecessor kept. All but the last return the columns of ``documents``:
toxic documents go, one document of each group of near copies stays, personal data and terms that
disclose it are replaced, and sources are interleaved to their target weights (the order of the
rows). The last encodes every text, checks that it decodes to itself, and gives each document its
turn in the mix, since encoding does not keep the order of rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from huntlake.llm import bpe, mixing, ngram_join, sanitise, toxicity
from huntlake.llm.common import column, documents, fresh
from huntlake.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group stays; of identical rows one; rows without an
    id all stay."""
    found = ngram_join.near_duplicates(docs)
    key = fresh(docs, "_kept")
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    own = column(docs, "doc_id")
    rows = docs.join(kept, own.cast("long") == F.col(key), "left_semi")
    previous, text = fresh(docs, "_previous"), F.coalesce(F.col("text"), F.lit(""))
    rows = rows.withColumn(previous, F.lag(text).over(Window.partitionBy("doc_id").orderBy(text)))
    rows = rows.where(F.col(previous).isNull() | (F.col(previous) != text)).drop(previous)
    return rows.unionByName(docs.where(own.isNull()))


def take_out_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise.sanitised(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``turn``, ``place``, ``n_tokens``, ``ids``, ``intact`` (the ids decode to the text)."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, digest=True, packed=True)
    order, names = mixing.schedule(docs.select("doc_id", "source"), mixing.tempered_targets(docs))
    order = order.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min_by(names["turn"], F.struct(names["turn"], names["place"])).alias("turn"),
        F.min_by(names["place"], F.struct(names["turn"], names["place"])).alias("place"))
    # the ids are checked and unpacked after the join, whose shuffle carries them packed
    checked = bpe.with_round_trip(encoded.join(order, "doc_id", "left"), ranks)
    return checked.select("doc_id", "turn", "place", "n_tokens", "ids", "intact")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("personal_data", take_out_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode_texts),
]

#: Trained weights, similarity groups and merges have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        out = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
