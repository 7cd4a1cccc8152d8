"""The registered queries of these operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions.core import let
from presswork.session import scratch_path, written

from . import audit, collocations, decontamination, fitting, mixing, near_duplicates, packing, pii, quality, secrets, spans, substrings, toxicity, training_order, vectors

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf)

    REGISTRY[fn.__name__] = run
    return run


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def of_kind(found, kind: str):
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query
def op1_toxicity(spark, sf):
    """Lexicon score of each document."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(docs, labels, use=~fitting.held_out(F.col("doc_id")))
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", fitting.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "terms"
    )


@query
def op2_near_vectors(spark, sf):
    """Near-duplicate class and number of links of each vector."""
    return vectors.near_vectors(table(spark, sf, "embeddings")).withColumnRenamed("id", "vec_id")


@query
def op3_training_order(spark, sf):
    """Training shards of all documents."""
    shards = training_order.training_shards(table(spark, sf, "documents"))
    return shards.withColumn("sha256", F.sha2("payload", 256))


@query
def op4_pii(spark, sf):
    """Personal data in each document."""
    docs = table(spark, sf, "documents")
    found = pii.find_personal_data(docs, pii.fit(docs), keep=["doc_id"])
    base = F.filter("pii", lambda s: s["rank"] < len(pii.BASE))
    return found.select(
        "doc_id", *[of_kind("pii", k) for k in pii.BASE], F.sha2(spans.listed(base), 256).alias("base_sha256"),
        spans.listed(F.col("pii")).alias("spans"),
    )


@query
def op5_mixing(spark, sf):
    """Words that the mix takes of each document."""
    plan = mixing.plan_mix(table(spark, sf, "documents"))
    return mixing.each_copy(plan).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken")
    )


@query
def op6_substrings(spark, sf):
    """What is left of each document without passages of earlier ones."""
    return substrings.remove_repeats(table(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query
def op7_secrets(spark, sf):
    """Secrets in each document, through a new ledger in the shared folder."""
    found = secrets.scan_secrets(table(spark, sf, "documents"), scratch_path(spark, "secret-ledger"))
    base = F.filter("findings", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        F.col("path").alias("doc_id"), *[of_kind("findings", k) for k in ("assign", "access", "hex")],
        F.sha2(spans.listed(base), 256).alias("base_sha256"), spans.listed(F.col("findings")).alias("spans"),
    )


@query
def op8_near_duplicates(spark, sf):
    """Near-duplicate class of each document."""
    return near_duplicates.near_duplicates(table(spark, sf, "documents"), similarity=0.85).withColumnRenamed("id", "doc_id")


@query
def op9_decontamination(spark, sf):
    """Benchmark passages in each document."""
    rows = decontamination.find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    ids = F.coalesce(F.array_sort(F.transform("items", lambda i: i.cast("string"))), F.array().cast("array<string>"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op10_quality(spark, sf):
    """Compression score of each document."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(docs, labels, use=~fitting.held_out(F.col("doc_id")))
    return quality.score(docs, model, keep=["doc_id"]).select(
        "doc_id", fitting.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op11_filter_audit(spark, sf):
    """What each of five filters removes after any others, in every order and language."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    text, marks = F.coalesce("text", F.lit("")), ("quality", "toxic")

    def failures(words):
        capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
        few, same = F.size(words) < 100, 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)
        return audit.failed([few, same, 100 * capitals > 10 * F.length(text), text.rlike(r"[#$%&*|]")])

    rows = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"),
        let(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), failures).alias("mask"),
    )
    rows = audit.mark_repeats(written(rows, "failures"), "doc_id", "key", "mask", 4)
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(*[F.max((F.col(m) == 1).cast("int")).alias(m) for m in marks])
    rows = rows.join(known, F.col("doc_id") == F.col("_id"), "left")
    found = audit.audit(rows, list("ABCDE"), "part", "mask", {"quality": "good_lost", "toxic": "toxic_lost"})
    return found.drop("filter")


@query
def op12_collocations(spark, sf):
    """Each language's first 2,000 phrases by how much their words keep company."""
    return collocations.collocations(table(spark, sf, "documents"), top=2000)


@query
def op13_packing(spark, sf):
    """The sequence and offset of every piece of every document."""
    placed = packing.pack(table(spark, sf, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc32").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset"
    )
