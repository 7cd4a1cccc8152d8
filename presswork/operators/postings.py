"""Where tokens are in texts, and phrases found from that, for any number of phrases.

A posting is (token, id, field, positions), one row for each distinct token of a field.  A
phrase is looked up from its rarest token: that token's places give the starts it may have,
and every other token keeps those starts that agree with its own places in the same field.
Tokens that no phrase has take no part; a token that is in most texts is only met within
(token, id, field), where the rarest one has been already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let
from ..session import written


def positions(tokens: Column) -> Column:
    """Array of (token, positions) for the distinct tokens of a text; positions count from 1."""

    def runs(xs: Column) -> Column:
        n = F.size(xs)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(xs, i)["t"] != F.get(xs, i - 1)["t"]))

        def run(st: Column) -> Column:
            places = lambda s, j: F.transform(F.slice(xs, s + 1, F.coalesce(F.get(st, j + 1), n) - s), lambda x: x["p"])
            return F.transform(st, lambda s, j: F.struct(F.get(xs, s)["t"].alias("token"), places(s, j).alias("positions")))

        return F.when(n > 0, let(starts, run))

    return let(F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), (i + 1).alias("p")))), runs)


def token_postings(df: DataFrame, id_col: str, fields: dict[str, Column]) -> DataFrame:
    """(token, id, field, positions) of all fields; ``fields`` has their token arrays.

    Rows without id have none.
    """
    def of_field(name: str, tokens: Column) -> Column:
        return F.transform(positions(tokens), lambda x: F.struct(x["token"].alias("token"), F.lit(name).alias("field"), x["positions"].alias("positions")))

    each = [of_field(name, tokens) for name, tokens in fields.items()]
    none = F.array().cast("array<struct<token:string,field:string,positions:array<int>>>")
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.flatten(F.array(*[F.coalesce(e, none) for e in each]))).alias("_x"))
    return rows.select("_x.token", "id", "_x.field", "_x.positions").filter("token != ''")


def phrase_hits(postings: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, id, field, starts): where the phrases begin.

    ``phrases`` has ``phrase``, tokens joined by one blank.  Postings that are there several
    times count once.
    """
    tokens = phrases.select("phrase").filter("phrase != ''").distinct().select("phrase", F.posexplode(F.split("phrase", " ")).alias("offset", "token"))
    tokens = written(tokens, "phrase-tokens")
    wanted = postings.join(tokens.select("token").distinct(), "token", "left_semi")
    wanted = written(wanted.groupBy("token", "id", "field").agg(F.first("positions").alias("positions")), "wanted-postings")
    counted = tokens.join(wanted.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token", "left")
    rarest = counted.groupBy("phrase").agg(F.count(F.lit(1)).alias("size"), F.count("n").alias("known"), F.min(F.struct("n", "offset", "token")).alias("r"))
    rarest = written(rarest.filter("size = known").select("phrase", "size", F.col("r.offset").alias("offset"), F.col("r.token").alias("token")), "rarest-tokens")
    begin = lambda p, offset: F.transform(p, lambda x: x - F.col(offset))
    seeds = rarest.join(wanted, "token").select("phrase", "size", F.col("offset").alias("_at"), "id", "field", begin("positions", "offset").alias("starts"))
    seeds = written(seeds, "phrase-seeds")
    others = tokens.join(rarest.select("phrase", F.col("offset").alias("_at"), "size").filter("size > 1"), "phrase").filter("offset != _at")
    asked = seeds.filter("size > 1").join(others.select("phrase", "offset", "token"), "phrase")
    met = asked.join(wanted, ["token", "id", "field"]).withColumn("both", F.array_intersect("starts", begin("positions", "offset")))
    met = met.filter(F.size("both") > 0).groupBy("phrase", "id", "field", "size").agg(F.collect_list("both").alias("all"))
    common = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.get("all", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    long = met.filter(F.size("all") == F.col("size") - 1).select("phrase", "id", "field", F.array_sort(common).alias("starts")).filter(F.size("starts") > 0)
    return seeds.filter("size = 1").select("phrase", "id", "field", "starts").unionByName(long)
