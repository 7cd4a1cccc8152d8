"""The summary of many texts in order, without bringing the texts together.

A summary takes the first usable sentences of all texts joined by line breaks; a sentence
may go on from one text to the next.  What a text can add to it is bounded, so each text is
*shrunk* first, within its row: to its first usable sentences, and to what its open first and
last sentences need to be judged together with what their neighbours have.  Shrunk texts
in a row are joined and shrunk again, a bounded number at a time, as often as it takes;
no task ever holds more than that, however many texts a group has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.core import let, word_count
from ..session import written
from .numbering import number_within
from .running import running
from .selection import first_per

#: Sentences of a summary, and shrunk texts that are joined in one step.
TARGET, FAN_IN = 15, 64
#: What follows the sentences of a thin summary, and the beginning used without any, in characters.
REST, HEAD = 1_000, 2_000
#: In place of a long stretch that makes its sentence useless whatever surrounds it.
USELESS = " ".join(["x"] * 51)


# ------------------------------------------------------------------------------- shrinking


def _shrunk_part(part: Column) -> Column:
    """A part of a sentence, bounded: in any sentence it gives the same first pieces.

    Up to 50 words it stays as it is.  A longer one counts by its clauses, so inner ones are
    left out beyond those that a summary can take; if one of them does not fit, nothing
    of the sentence does.
    """

    def bounded(clauses: Column) -> Column:
        n = F.size(clauses)
        length = lambda c: word_count(F.regexp_replace(c, "[,;:]$", ""))  # noqa: E731  the sign that ends a clause is not part of it
        inner = F.slice(clauses, F.lit(2), F.greatest(n - 2, F.lit(0)))
        outer_fit = (length(F.get(clauses, F.lit(0))) <= 30) & (length(F.get(clauses, n - 1)) <= 30)
        fits = (n > 1) & outer_fit & F.forall(inner, lambda c: length(c).between(5, 30))
        kept = F.concat(F.slice(clauses, F.lit(1), F.least(n - 1, F.lit(TARGET + 2))), F.slice(clauses, F.lit(-1), F.lit(1)))
        stop = F.right(part, F.lit(1))
        return F.when(fits, F.array_join(kept, " ")).otherwise(F.concat(F.lit(USELESS), F.when(stop.isin(".", "!", "?"), stop).otherwise(F.lit(""))))

    return F.when(word_count(part) <= 50, part).otherwise(let(F.split(part, r"(?<=[,;:])\s+", -1), bounded))


def shrunk(text: Column | str) -> Column:
    """A bounded text with the same first usable pieces, also when other texts surround it."""

    def shrink(sentences: Column) -> Column:
        n = F.size(sentences)
        inner = F.filter(F.slice(sentences, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda s: F.size(X.sentence_pieces(s)) > 0)
        first, last = F.slice(sentences, F.lit(1), F.lit(1)), F.slice(sentences, F.lit(-1), F.lit(1))
        kept = F.when(n == 1, first).otherwise(F.concat(first, F.slice(inner, F.lit(1), F.lit(TARGET)), last))
        return F.array_join(F.transform(kept, _shrunk_part), " ")

    return let(X.split_sentences(text), shrink)


def _joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Shrunk texts of each group, at most ``FAN_IN`` or ``start`` of them, as one."""
    together = F.sort_array(F.collect_list(F.struct("_n", "_s")))
    return rows.groupBy(*keys).agg(together.alias("_t")).select(
        *keys, F.size("_t").alias("_size"), F.array_join(F.col("_t._s"), "\n").alias("_s")
    )


def folded(rows: DataFrame, group: str) -> DataFrame:
    """(group, _s): the shrunk texts of each group as one; ``_n`` numbers them from 1."""
    most = rows.agg(F.max("_n")).first()[0] or 0
    while most > 1:
        rows = rows.withColumn("_to", F.floor((F.col("_n") - 1) / FAN_IN) + 1)
        rows = _joined(rows, [group, "_to"]).select(group, F.col("_to").alias("_n"), shrunk("_s").alias("_s"))
        most = -(-most // FAN_IN)
        if most > 1:
            rows = written(rows, "folded-texts")
    return rows.select(group, "_s")


# ---------------------------------------------------------------------- parts of the joined text


def _window(texts: DataFrame, at: DataFrame, width: int) -> DataFrame:
    """(group, _w): ``width`` characters of each group's joined text from ``_at`` on.

    ``texts`` has _g, _n, _body and _start, the place where the text begins; every text has a
    character at least, so no more than ``width`` of them and two touch a window.
    """
    end = F.col("_start") + F.length("_body")
    near = texts.join(at.withColumnRenamed("_g", "_g2"), F.col("_g").eqNullSafe(F.col("_g2")))
    near = near.filter((end >= F.col("_at")) & (F.col("_start") <= F.col("_at") + width))
    skip = F.greatest(F.col("_at") - F.col("_start"), F.lit(0))
    part = F.substr("_body", (skip + 1).cast("int"), F.lit(width))
    parts = near.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_n", part.alias("_s")))).alias("_t"))
    # a window may begin at the line break between two texts
    return parts.select("_g", F.left(F.array_join(F.col("_t._s"), "\n"), F.lit(width)).alias("_w"))


def paragraph_lines(texts: DataFrame, most: int = 5, words: int = 10) -> DataFrame:
    """(_g, _para, _line_no, _line): the lines of each group's first paragraphs of over ``words`` words.

    Paragraphs are divided by pairs of line breaks.  The joined text's lines are the lines of
    its texts, one after the other: a pair is an empty line, of several in a row every
    second one, beginning with the first (the second at the very start).
    """
    split = F.split("_body", "\n", -1)
    counted = running(texts.withColumn("_n_lines", F.size(split).cast("long")), ["_g"], "_n", "_n_lines", "_before")
    lines = counted.select("_g", F.coalesce("_before", F.lit(0)).alias("_before"), F.posexplode(split).alias("_i", "_line"))
    lines = lines.select("_g", (F.col("_before") + F.col("_i") + 1).alias("_line_no"), "_line")
    lines = written(lines.withColumn("_full", F.when(F.col("_line") != "", F.col("_line_no"))), "lines")
    lines = running(lines, ["_g"], "_line_no", "_full", "_last", F.max)
    odd = (F.col("_line_no") - F.coalesce("_last", F.lit(0))) % 2 == 1
    divides = (F.col("_line") == "") & F.when(F.col("_last").isNull(), ~odd).otherwise(odd)
    lines = written(lines.withColumn("_divides", divides.cast("long")), "divided-lines")
    lines = running(lines, ["_g"], "_line_no", "_divides", "_para").withColumn("_para", F.coalesce("_para", F.lit(0)))
    lines = written(lines.filter("_divides = 0").select("_g", "_para", "_line_no", "_line"), "paragraphs")
    long_ones = lines.groupBy("_g", "_para").agg(F.sum(word_count("_line")).alias("_words")).filter(F.col("_words") > words)
    chosen = first_per(long_ones, ["_g"], ["_para"], most).select(F.col("_g").alias("_g2"), F.col("_para").alias("_para2"))
    return lines.join(chosen, F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_para") == F.col("_para2")), "left_semi")


# --------------------------------------------------------------------------------- summaries


def _from_pieces(rows: DataFrame) -> DataFrame:
    """(_g, _kept): usable pieces of a group's shrunk text, no more than a summary takes."""
    return rows.select("_g", F.slice(X.usable_sentences("_s"), F.lit(1), F.lit(TARGET)).alias("_kept"))


def _thin(texts: DataFrame, kept: DataFrame) -> list[DataFrame]:
    """Summaries of groups whose texts have some usable sentences, but too few."""
    partial = kept.select("_g", F.array_join("_kept", " ").alias("_partial"))
    after = _window(texts, partial.select("_g", F.length("_partial").cast("long").alias("_at")), REST)
    after = after.withColumnRenamed("_g", "_g2")
    rows = partial.join(after, F.col("_g").eqNullSafe(F.col("_g2")), "left")
    return [rows.select("_g", let(F.coalesce("_w", F.lit("")), lambda w: X.top_up(F.col("_partial"), w, TARGET)).alias("_summary"))]


def _useless(texts: DataFrame, groups: DataFrame) -> list[DataFrame]:
    """Summaries of groups without a usable sentence: their first long paragraphs, or how they begin.

    Such a summary is as long as its paragraphs; ``summary_lines`` has it line by line.
    """
    texts = texts.join(groups.select(F.col("_g").alias("_g2")), F.col("_g").eqNullSafe(F.col("_g2")), "left_semi")
    lines = written(paragraph_lines(texts), "paragraph-lines")
    by_para = lines.groupBy("_g", "_para").agg(F.sort_array(F.collect_list(F.struct("_line_no", "_line"))).alias("_l"))
    by_para = by_para.select("_g", "_para", F.array_join(F.col("_l._line"), "\n").alias("_p"))
    made = by_para.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_para", "_p"))).alias("_l"))
    made = made.select("_g", F.array_join(F.col("_l._p"), " ").alias("_summary"))
    found = lines.select(F.col("_g").alias("_g2")).distinct()
    short = groups.join(found, F.col("_g").eqNullSafe(F.col("_g2")), "left_anti").select("_g", F.lit(0).cast("long").alias("_at"))
    return [made, _window(texts, short, HEAD).select("_g", X.cut_head(F.col("_w")).alias("_summary"))]


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Texts with their number in the group and where they begin in its joined text."""
    texts = written(number_within(rows, "_g", order, "_n").withColumn("_width", F.length("_body").cast("long") + 1), "numbered-texts")
    return written(running(texts, ["_g"], "_n", "_width", "_start").withColumn("_start", F.coalesce("_start", F.lit(0))), "placed-texts")


def summaries(df: DataFrame, group: str, order: list[str], body: Column, start: int = 32) -> DataFrame:
    """(group, digest_summary) over all texts of each group, in ``order`` (a total order).

    A summary ends with its fifteenth usable sentence, so the first ``start`` texts mostly
    decide it.  Only groups in which they do not have all of their texts looked at.
    """
    rows = df.select(F.col(group).alias("_g"), *order, body.alias("_body")).filter(F.col("_body") != "")
    first = first_per(rows, ["_g"], order, start, out="_n").select("_g", "_n", shrunk("_body").alias("_s"))
    first = _joined(first, ["_g"])
    # the last sentence may go on in the next text
    whole = let(X.split_sentences("_s"), lambda s: F.array_join(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), " "))
    complete = F.when(F.col("_size") < start, F.col("_s")).otherwise(whole)
    kept = _from_pieces(first.withColumn("_s", complete))
    decided = F.size("_kept") >= TARGET
    parts = [kept.filter(decided).select("_g", F.array_join("_kept", " ").alias("_summary"))]
    undecided = written(kept.filter(~decided).select(F.col("_g").alias("_g2")), "undecided-groups")
    if not undecided.isEmpty():
        rest = rows.join(undecided, F.col("_g").eqNullSafe(F.col("_g2")), "left_semi")
        texts = _numbered(rest, order)
        shrunken = written(texts.select("_g", "_n", shrunk("_body").alias("_s")), "shrunk-texts")
        kept = written(_from_pieces(folded(shrunken, "_g")), "all-sentences")
        enough = kept.filter(F.size("_kept") >= TARGET)
        parts.append(enough.select("_g", F.array_join("_kept", " ").alias("_summary")))
        parts += _thin(texts, kept.filter((F.size("_kept") > 0) & (F.size("_kept") < TARGET)))
        useless = kept.filter(F.size("_kept") == 0)
        if not useless.isEmpty():
            parts += _useless(texts, useless)
    return reduce(DataFrame.unionByName, parts).select(F.col("_g").alias(group), F.col("_summary").alias("digest_summary"))


def summary_lines(df: DataFrame, group: str, order: list[str], body: Column) -> DataFrame:
    """(group, paragraph, line_no, line): what a summary without usable sentences consists of.

    One row per line, for groups whose paragraphs may be as long as all their texts.
    """
    rows = df.select(F.col(group).alias("_g"), *order, body.alias("_body")).filter(F.col("_body") != "")
    lines = paragraph_lines(_numbered(rows, order))
    return lines.select(F.col("_g").alias(group), F.col("_para").alias("paragraph"), F.col("_line_no").alias("line_no"), F.col("_line").alias("line"))
