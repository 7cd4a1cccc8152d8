"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the total by weight.  A source stops at ``max_epochs`` times
its own size; what it cannot take is shared again by weight until every source is below its
stop.  That fixed point is ``min(cap, level * weight)`` for one common level, which is found
over the sources sorted by ``cap / weight``.

A source whose target is ``e`` times its size repeats every document ``floor(e)`` times and
draws the remaining fraction of its words without replacement, in the order of a seeded
hash; the draw ends where the words drawn come nearest to the fraction, and one further
document, the one whose size comes nearest to what is missing, closes the gap.  Rows alike in
id, source and size stand beside one another in that order and are drawn one by one.

Targets are worked out over the table of sources in one task: hundreds of thousands of
sources are fine, more are refused (``MOST_SOURCES``).

Only (id, source, size) rows are shuffled.  The draw needs running sums within a source;
these are taken within 4,096 hash ranges of each source, so a source with a third of all
rows is spread over as many tasks.

Defined cases: null text has size 0; null source is a source, sorted last; of rows alike in
id, source and size some may be repeated once more than others; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.session import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
MOST_SOURCES = 1_000_000
#: Alike rows that are put into one array.
COPIES_STEP = 1024
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(id_col: Column, seed: str) -> Column:
    """Hex digits that order the documents of a source at random."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null"))))


def water_fill(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """Targets of a table (source, source_size) with one row per source.

    Weights go to the sources in code point order, null last, and repeat.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(w).cast("long") for w in weights])
    rows = sources.withColumn(
        "weight", F.get(pick, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    ).withColumn("cap", F.col("source_size") * max_epochs)
    everything = Window.partitionBy(F.lit(0))
    # Sources in the order in which a rising level reaches their cap.
    rising = everything.orderBy(
        (F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("cap").over(rising), F.lit(0)).alias("full"),
        F.coalesce(F.sum("weight").over(rising), F.lit(0)).alias("full_weight"),
    )
    # The level if exactly the sources before this one stop at their cap.
    left, share = F.col("total") - F.col("full"), F.col("weights") - F.col("full_weight")
    open_ = left * F.col("weight") <= F.col("cap") * share
    rows = rows.select("*", F.when(open_, F.struct(F.col("full_weight").alias("k"), left.alias("left"), share.alias("share"))).alias("level"))
    level = F.min("level").over(everything)
    return rows.select(
        "source",
        "source_size",
        "weight",
        F.when(level.isNull() | (F.col("full_weight") < level["k"]), F.col("cap").cast("double"))
        .otherwise((level["left"] * F.col("weight")).cast("double") / level["share"])
        .alias("target"),
    )


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """How often each document is used: (id, source, size, copies, source_size, target, repeats).

    ``copies`` rows of that id, source and size are used ``repeats`` times each.  Where only
    some of the rows alike are used once more, there is a row of the plan for either part.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    rows = written(
        rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("copies")).select(
            "*", hash_key(F.col("id"), seed).alias("key"), (F.col("size") * F.col("copies")).alias("words")
        ).withColumn("part", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")),
        "mix-rows",
    )
    parts = written(rows.groupBy("source", "part").agg(F.sum("words").alias("words")), "mix-parts")
    sizes = written(parts.groupBy("source").agg(F.sum("words").alias("source_size")), "mix-sources")
    if sizes.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    targets = water_fill(sizes, weights, max_epochs)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("part_from"))
    targets = written(targets, "mix-targets").withColumnRenamed("source", "of")
    within = (
        Window.partitionBy("source", "part").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn("in_part", F.coalesce(F.sum("words").over(within), F.lit(0)))
    rows = rows.join(
        parts.withColumnsRenamed({"source": "p_source", "part": "p_part"}),
        (F.col("part") == F.col("p_part")) & F.col("source").eqNullSafe(F.col("p_source")),
    ).join(targets, F.col("source").eqNullSafe(F.col("of")))
    whole_times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    extra = F.col("target") - whole_times * F.col("source_size")
    # of the copies, those before whose middle the fraction is not reached
    before = F.col("part_from") + F.col("in_part")
    reached = F.floor((extra * 2 - F.col("size") - before * 2) / (F.col("size") * 2)) + 1
    drawn = F.when((extra > 0) & (F.col("size") > 0), F.greatest(F.lit(0), F.least(F.col("copies"), reached))).otherwise(F.lit(0)).cast("long")
    rows = rows.select(
        "id", "source", "size", "copies", "key", "source_size", "target", whole_times.alias("times"), extra.alias("extra"), drawn.alias("drawn")
    )
    rows = written(rows, "mix-drawn")
    gaps = rows.groupBy(F.col("source").alias("of")).agg((F.first("extra") - F.sum(F.col("drawn") * F.col("size"))).alias("gap"))
    gaps = written(gaps, "mix-gaps")
    own = F.col("source").eqNullSafe(F.col("of"))
    off = F.abs(F.col("size") - F.col("gap"))
    closing = rows.filter((F.col("drawn") < F.col("copies")) & (F.col("size") > 0)).join(gaps, own).filter(off < F.col("gap"))
    closing = closing.groupBy(F.col("source").alias("of")).agg(F.min(F.struct(off.alias("off"), "key", "size")).alias("last"))
    rows = rows.join(written(closing, "mix-closing"), own, "left")
    closes = F.coalesce((F.col("key") == F.col("last.key")) & (F.col("size") == F.col("last.size")), F.lit(False))
    more = F.col("drawn") + F.when(closes, F.lit(1)).otherwise(F.lit(0))
    part = lambda n, times: F.struct(n.cast("long").alias("copies"), times.cast("long").alias("repeats"))
    parts = F.filter(F.array(part(more, F.col("times") + 1), part(F.col("copies") - more, F.col("times"))), lambda p: p["copies"] > 0)
    rows = rows.select("id", "source", "size", "source_size", "target", F.explode(parts).alias("p"))
    return rows.select("id", "source", "size", "p.copies", "source_size", "target", "p.repeats")


def each_copy(plan: DataFrame) -> DataFrame:
    """The plan with one row per document; no array holds all copies of a row."""
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES_STEP)))
    rows = plan.withColumn("_step", steps)
    first = F.col("_step") * COPIES_STEP + 1
    return rows.withColumn("_copy", F.explode(F.sequence(first, F.least(F.col("copies"), first + COPIES_STEP - 1)))).drop("_step", "_copy")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mixed rows themselves, each as often as the plan uses it.

    Of alike rows that are not all used as often, the first ones of the table get one use
    more; they are numbered by task, so that no group of them has to fit one.
    """
    plan = written(plan_mix(docs, id_col, text_col, source_col, **settings), "mix-plan")
    keys = {"id": "of", "source": "of_source", "size": "of_size"}
    rows = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    same = lambda: F.col("id").eqNullSafe(F.col("of")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))
    times = lambda n: F.explode(F.sequence(F.lit(1), n.cast("int")))
    plan = plan.withColumnsRenamed(keys).groupBy(*keys.values()).agg(
        F.min("repeats").alias("repeats"), F.max("repeats").alias("most"), F.max_by("copies", "repeats").alias("more")
    )
    plan = written(plan, "mix-uses")
    alike = plan.filter("repeats = most and repeats > 0").select(*keys.values(), "repeats")
    out = rows.join(alike, same()).select("row", times(F.col("repeats")).alias("copy")).select("row.*")
    some = written(plan.filter("repeats < most").select(*keys.values(), "repeats", "more"), "mix-some")
    if some.isEmpty():
        return out
    chosen = written(rows.join(some, same()).drop("of", "of_source", "of_size"), "mix-alike").withColumn("_at", F.monotonically_increasing_id())
    group, part = ["id", "source", "size"], F.shiftright("_at", 33)
    chosen = chosen.withColumn("_part", part).withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_part").orderBy("_at")))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = chosen.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_all")).withColumn("_before", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    parts = parts.select(*[F.col(g).alias(keys[g]) for g in group], F.col("_part").alias("_p"), "_before")
    numbered = chosen.join(parts, same() & (F.col("_part") == F.col("_p")))
    uses = F.col("repeats") + (F.col("_n") + F.col("_before") <= F.col("more")).cast("long")
    numbered = numbered.withColumn("uses", uses).filter("uses > 0")
    return out.unionAll(numbered.select("row", times(F.col("uses")).alias("copy")).select("row.*"))
