"""Secret scans with an incremental ledger of scanned blobs.

Every version of a text is addressed by the SHA-256 of its content.  The ledger is a table
(blob, rule, version, spans) with one row for every blob and rule version that has been
scanned, also where nothing was found.  A run scans the pairs that the ledger lacks, each
blob once however many paths hold it, appends them in one commit, and joins the findings
back to all paths.  A new version of a rule scans all blobs for that rule alone.

The blobs to scan are chosen from narrow rows; a representative path brings the text.  Texts
are exchanged once, by (blob, path), to meet what was chosen, and a blob is scanned once
however many paths it has.  Scanning is column expressions only.

Defined cases: null text is the empty blob; null paths are paths; rows alike in everything
each get their findings; an empty table leaves the ledger as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.session import written

from . import spans as S


@dataclass(frozen=True)
class Rule:
    """A pattern; of its matches those count whose ``value`` has ``least`` characters.

    ``value`` is a pattern whose first group is measured, by default the whole match.
    A change of any of these needs a new version.
    """

    kind: str
    version: int
    pattern: str
    least: int = 1
    value: str | None = None

    def spans(self, text: Column) -> Column:
        found = S.find(text, self.pattern)
        if self.least > 1:
            size = lambda s: F.length(F.regexp_extract(s["text"], self.value, 1) if self.value else s["text"])
            found = F.filter(found, lambda s: size(s) >= self.least)
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


_NAME = r"(?i:password|passwd|secret|token|api_?key)"
_SET = r"""["']?\x20*[:=]\x20*["']?"""
RULES = (
    Rule("assign", 1, rf"{_NAME}{_SET}[A-Za-z0-9+/_.=-]+", 8, rf"^{_NAME}{_SET}([A-Za-z0-9+/_.=-]+)$"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 16),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{32,}"),
    Rule("private", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("vendor", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35})"),
)
_LEDGER = "blob string, rule string, version int, spans array<struct<start:int,end:int>>"


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger, empty if nothing has been written yet."""
    try:
        return spark.read.schema(_LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


def update_ledger(docs: DataFrame, ledger: str, path_col: str, text_col: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what the ledger at this path lacks and append it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(F.sha2("text", 256).alias("blob"), "path", "text")
    have = read_ledger(spark, ledger).groupBy(F.col("blob").alias("_blob")).agg(F.collect_set(F.struct("rule", "version")).alias("have"))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    nothing = F.expr("cast(array() as array<struct<rule:string,version:int>>)")
    lacking = F.array_except(wanted, F.coalesce("have", nothing))
    todo = (
        rows.groupBy("blob").agg(F.min("path").alias("first"))
        .join(have, F.col("blob") == F.col("_blob"), "left")
        .select(F.col("blob").alias("todo_blob"), "first", lacking.alias("todo"))
        .filter(F.size("todo") > 0)
    )
    todo = written(todo, "unseen-blobs")
    scans = rows.join(todo, (F.col("blob") == F.col("todo_blob")) & F.col("path").eqNullSafe(F.col("first")))

    def scanned(r: Rule) -> Column:
        name = F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"))
        return F.when(F.array_contains("todo", name), F.struct(name["rule"].alias("rule"), name["version"].alias("version"), r.spans(F.col("text")).alias("spans")))

    scans = scans.select("blob", F.explode(F.filter(F.array(*map(scanned, rules)), lambda x: x.isNotNull())).alias("s"))
    scans = scans.groupBy("blob", "s.rule", "s.version").agg(F.first("s.spans").alias("spans"))
    scans.select("blob", "rule", "version", "spans").write.mode("append").parquet(ledger)


def scan_secrets(
    docs: DataFrame, ledger: str, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """One row per row of ``docs``: (path, blob, findings), after bringing the ledger up to date.

    ``findings`` are (start, rank, kind, end), sorted; ``rank`` is the rule's place.
    """
    update_ledger(docs, ledger, path_col, text_col, rules)
    current = F.array(*[F.concat_ws("|", F.lit(r.kind), F.lit(r.version)) for r in rules])
    known = read_ledger(docs.sparkSession, ledger).filter(F.size("spans") > 0)
    known = known.filter(F.array_contains(current, F.concat_ws("|", "rule", "version")))
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule")).cast("int")
    each = F.transform(
        "spans", lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), F.col("rule").alias("kind"), s["end"].alias("end"))
    )
    known = known.groupBy("blob", "rule").agg(F.first(each).alias("s")).groupBy(F.col("blob").alias("_blob")).agg(
        F.sort_array(F.flatten(F.collect_list("s"))).alias("findings")
    )
    rows = docs.select(F.col(path_col).alias("path"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")
    return rows.join(known, F.col("blob") == F.col("_blob"), "left").select("path", "blob", F.coalesce("findings", none).alias("findings"))
