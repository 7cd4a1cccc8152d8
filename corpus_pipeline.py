"""From documents to training shards: five stages, each a training-data operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm import decontamination, fitting, mixing, near_duplicates, quality, training_order
from presswork.session import remove, settled, written

#: Documents that score less are rejected.
LEAST_QUALITY = 0.3
#: Documents that share this part of their five-word shingles are near-duplicates.
SIMILARITY = 0.8


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression score is not low."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, use=~fitting.held_out(F.col("doc_id")))
    rows = docs.select(F.struct("*").alias("row"), "text")
    return quality.score(rows, model, keep=["row"]).filter(F.col("score") >= LEAST_QUALITY).select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Rows that share an id stand or fall together; of rows alike in everything one stays.
    """
    found = near_duplicates.near_duplicates(docs, similarity=SIMILARITY)
    gone = written(found.filter(~F.col("kept")).select(F.col("id").alias("doc_id")).distinct(), "near-copies")
    repeated = written(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    once = left.join(repeated, "doc_id", "left_anti")
    more = left.join(repeated, "doc_id", "left_semi").dropDuplicates()
    return once.select(*docs.columns).unionByName(more.select(*docs.columns))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; a text decides for all that equal it."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = F.md5(F.coalesce("text", F.lit(""))).alias("key")
    found = decontamination.find_contamination(docs.select(key, "text"), bench, id_col="key")
    hit = written(found.filter("n_hit > 0").select(F.col("id").alias("key")).distinct(), "contaminated")
    return docs.select(F.struct("*").alias("row"), key).join(hit, "key", "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training shards of the mixed documents."""
    return training_order.training_shards(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID binary output", shards),
]

#: Compression and tokenization are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again.

    A stage's own tables go when it has been written, its input when the next one has.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = settled(spark, lambda: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            remove(spark, before)
        before = path
    return docs
