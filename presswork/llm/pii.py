"""Personal data by candidate spans, boosted trees and calibrated thresholds.

Fixed rules find the certain kinds (``BASE``).  Beside these, generators of high recall
propose spans that may overlap: digit groups, account numbers, disguised addresses, network
addresses of the newer kind.  Every proposal is described by its format and its context and
scored by gradient boosted trees; for each kind, the lowest threshold that keeps the wanted
precision on what was left out of training decides.  Of these, spans that overlap a certain
one or lie within another go.

The trees are fitted on all documents.  From these come spans with
the shape of a certain kind, labelled by its check, and proposals, labelled where a check
can tell: account numbers by their check digits, digit groups by the certain spans that they
are part of, or, as things, by the check digit of a book number or a failing card number.
The rest are ``EXAMPLES``, filled-in formats; every third format of each kind and label
is left out whole, so thresholds are set on formats that the trees have not seen.  Spans of
documents are counted by what describes them, so trees and thresholds come from counts of
all of them; beyond ``WEIGHT_DOCS`` documents the counts are scaled to what so many would give, as
the formats would not matter beside those of a large table.  The trees are turned into CASE expressions, so a document is scored within its row: no shuffle, no
Python.

Defined cases: null and empty texts have no spans; rows are judged one by one; documents
without id take no part in fitting; an empty table fits on the formats alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions.core import let
from presswork.session import written

from . import spans as S

#: Documents that the formats are balanced against; all are counted, however many there are.
WEIGHT_DOCS = 5_000
TREES, DEPTH, PRECISION = 20, 4, 0.97

# Shapes of the certain kinds.  Possessive loops match the same spans as plain ones here and
# neither recurse nor try again within a long run; \G stands for a match that begins where
# the one before it ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSED = {
    "number": r"(?<![0-9A-Za-z+.@_/-])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,18}(?![0-9A-Za-z@_])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "handle": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[(\[{]at[)\]}]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}(?:(?:\x20?(?:\.|[(\[{]dot[)\]}])\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,5}",
    "ip6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){0,6}(?:[0-9A-Fa-f]{1,4})?::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
}
KINDS = [*BASE, *PROPOSED]

# Formats to learn from, (kind, personal, before, format, after): # is any digit, ? any small
# letter, ^ any capital, and %% the check digits of an account number.
EXAMPLES = [
    ("number", 1, "call me at ", "###-###-####", " today"), ("number", 1, "tel. ", "(###) ###-####", "."), ("number", 1, "phone: ", "### ### ####", ", please"),
    ("number", 1, "mobile ", "0## ########", " or"), ("number", 1, "my number is ", "###.###.####", " and"), ("number", 1, "my ssn is ", "###-##-####", "."),
    ("number", 1, "ssn ", "###-##-####", ","), ("number", 1, "social security number ", "###-##-####", " of"), ("number", 1, "Telefon ", "0### #######", ","),
    ("number", 1, "tel ", "0##/#######", " or"), ("number", 1, "fax ", "##-##-##-##-##", "."), ("number", 1, "Tel.: ", "0####/######", " (abends"),
    ("number", 1, "passport no. ", "#########", " issued"), ("number", 1, "mobil: ", "01## #######", "."), ("number", 1, "cell ", "###-###-####", " after"),
    ("number", 1, "ring the phone ", "0## #### ####", " at"), ("number", 1, "whatsapp ", "0#########", "!"), ("number", 1, "her phone number is ", "(0##) #### ####", "."),
    ("number", 0, "version ", "##.##.####", " of"), ("number", 0, "order ", "########", " was"), ("number", 0, "on ", "20##-1#-2#", " the"),
    ("number", 0, "price ", "#.###.###", " per"), ("number", 0, "isbn ", "978-#-##-######-#", "."), ("number", 0, "of the ", "################", " and"),
    ("number", 0, "in ", "19##-20##", " there"), ("number", 0, "population ", "## ### ###", " in"), ("number", 0, "", "#######", ""),
    ("number", 0, "the ", "##########", " units"), ("number", 0, "was ", "###############", " in"), ("number", 0, "lot ", "####-####-##", " of"),
    ("number", 0, "invoice ", "20##-######-##", " is"), ("number", 0, "part ", "###-####-###", " fits"), ("number", 0, "from ", "##/##/20##", " to"),
    ("number", 0, "ticket ", "####-##-####", " was"), ("number", 0, "serial ", "###.####.####", " and"), ("number", 0, "batch ", "##-######-#", " came"),
    ("number", 0, "code ", "#### ### ####", " for"), ("number", 0, "case ", "##-####-####", " in"), ("number", 0, "about ", "# ### ### ###", " people"),
    ("account", 1, "IBAN ", "DE%% #### #### #### #### ##", "."), ("account", 1, "account ", "GB%%^^^^##############", " at"), ("account", 1, "pay to ", "FR%% #### #### #### #### #### ###", ","),
    ("account", 1, "to ", "AT%%################", " by"), ("account", 1, "IBAN: ", "ES%% #### #### #### #### ####", " of"), ("account", 1, "", "CH%%#################", " until"),
    ("account", 0, "part ", "^^##^^^^^^^^^^^^", " of"), ("account", 0, "code ", "^^##^^^^^^^^####", " and"), ("account", 0, "model ", "^^## ^^^^ #### ####", " in"),
    ("account", 0, "IBAN ", "DE## #### #### #### #### ##", "."), ("account", 0, "key ", "^^##^#^##^^#^##^####", " for"), ("account", 0, "account ", "GB##^^^^##############", " at"),
    ("handle", 1, "write to ", "????.????? (at) ????.example", "."), ("handle", 1, "contact ", "?##[at]???????[dot]org", " for"), ("handle", 1, "mail ", "?????? at ??????? dot com", " or"),
    ("handle", 1, "", "????_???? at ??????? dot co dot uk", " any"), ("handle", 1, "e-mail: ", "?.?????## (at) ?????? (dot) net", ","), ("handle", 1, "reach me: ", "????## at ????.com", " or"),
    ("handle", 1, "mail to ", "?????{at}?????{dot}de", " now"), ("handle", 1, "please contact ", "?????.?????? at ?????? dot org", "."), ("handle", 1, "(", "????? [at] ??????.com", ")"),
    ("handle", 0, "we ", "met at noon. then", " went"), ("handle", 0, "and ", "looked at it. the", " other"), ("handle", 0, "she ", "was at ????. ???", " and"),
    ("handle", 0, "the ", "????? at ??????. ??????", " is"), ("handle", 0, "all ", "???? at ?????. it", " had"), ("handle", 0, "he ", "????? at ###. ????", " of"),
    ("handle", 0, "to ", "???? (at) ????. ??????", " who"), ("handle", 0, "is ", "??? at ????? . ???", " by"), ("handle", 0, "they ", "arrived at ??????. ??????????", " a"),
    ("ip6", 1, "from ", "2001:0db8:####:####:####:####:####:####", " port"), ("ip6", 1, "host ", "2001:db8::#", " is"), ("ip6", 1, "at ", "fe80::#?a#:##ff:fe##:##a#", " on"),
    ("ip6", 1, "to ", "2a0#:####::##:#", "."), ("ip6", 1, "address ", "fd##:#a##:##c#::1", ","), ("ip6", 1, "via ", "26##:####:##e#:#::##", " to"),
    ("ip6", 0, "at ", "00:##:##:##:##:##:##:##", " h"), ("ip6", 0, "class ", "a::b", " of"), ("ip6", 0, "see ", "##:##:##:##:##:##:##:##", " in"),
    ("ip6", 0, "namespace ", "dead::beef", " is"), ("ip6", 0, "verse ", "#::#", " and"), ("ip6", 0, "of ", "fed::add", " the"),
]
PER_EXAMPLE = 60
#: Distinct descriptions that a task fits trees on.
ROWS_PER_TASK = 50_000
#: One format in so many of each kind and label sets thresholds.
HELD_OUT = 3

# Words around a span, by what they speak for.
CONTEXT = {
    "phone": r"(?i)call|phone|tel|mobil|fax|cell|number is|whatsapp",
    "person": r"(?i)ssn|social sec|passport|born|iban|account|pay|birth|ausweis|licen[cs]e",
    "mail": r"(?i)mail|write|contact|@",
    "thing": r"(?i)version|order|isbn|price|part|code|page|popul|units|no\. of|total|\bin \b|\bof the\b",
}
FEATURES = [
    "kind", "length", "digits", "letters", "gaps", "groups", "longest", "dots", "dashes", "luhn", "year", "zero",
    "bracket", "upper", "ends", "colons", "slashes", "spelled", "tail", "iban", *CONTEXT,
]


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the check sum; false for any other number of digits."""

    def doubled(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), "", 19), doubled), F.lit(0), lambda a, b: a + b)
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def account_rest(text: Column) -> Column:
    """An account number modulo 97 with its first four signs last and letters as numbers; valid ones give 1."""

    def step(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[A-Z]"), (rest * 100 + letter) % 97).otherwise((rest * 10 + c.cast("int")) % 97)

    plain = F.regexp_replace(text, r"\x20", "")
    turned = let(plain, lambda t: F.concat(F.substr(t, F.lit(5)), F.left(t, F.lit(4))))
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def book_number(digits: Column) -> Column:
    """Whether 13 digits are a book number with the right check digit."""
    weigh = lambda c, i: c.cast("int") * F.when(i % 2 == 1, 3).otherwise(1)
    total = F.aggregate(F.transform(F.split(digits, "", 13), weigh), F.lit(0), lambda a, b: a + b)
    return F.when(digits.rlike("^97[89][0-9]{10}$"), total % 10 == 0).otherwise(F.lit(False))


def passes(kind: str, text: Column) -> Column:
    """The check of a certain kind on a span of its shape."""
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return text.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return luhn(digits_of(text))
    if kind == "phone":
        return F.length(digits_of(text)).between(9, 15)
    return F.lit(True)


def _named(spans: Column, kind: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            F.lit(KINDS.index(kind)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"),
            s["text"].alias("text"), s["left"].alias("left"), s["right"].alias("right"),
        ),
    )


def shaped(text: Column) -> Column:
    """Every span with the shape of a certain kind, by kind, then position."""
    return F.concat(*[_named(S.find(text, p), k) for k, p in BASE.items()])


def proposals(text: Column) -> Column:
    return F.concat(*[_named(S.find(text, p), k) for k, p in PROPOSED.items()])


def checked(span: Column) -> Column:
    test = F.lit(False)
    for k in BASE:
        test = F.when(span["kind"] == k, passes(k, span["text"])).otherwise(test)
    return test


def described(s: Column) -> list[Column]:
    """The features of a span, in the order of ``FEATURES``."""
    text, count = s["text"], lambda p: F.regexp_count(s["text"], F.lit(p))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    groups = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))
    around = F.concat(s["left"], F.lit(" "), s["right"])
    made = [
        s["rank"], F.length(text), count("[0-9]"), count("[A-Za-z]"), count(r"\x20"), F.size(groups),
        F.aggregate(groups, F.lit(0), lambda a, g: F.greatest(a, F.length(g))), count(r"\."), count("-"), flag(luhn(digits_of(text))),
        flag(text.rlike("(?:19|20)[0-9]{2}(?:[^0-9]|$)")), flag(text.rlike("^[(]?0")), flag(text.rlike(r"[(\[{]")), count("[A-Z]"),
        flag(s["right"].rlike(r"^(?:$|[\s.,;:!?)\]])")), count(":"), count("/"), flag(text.rlike(r"(?i)\bdot\b")),
        flag(text.rlike(r"(?:\.|dot[)\]}]?\x20?)[A-Za-z]{2,7}$")), F.when(s["kind"] == "account", flag(account_rest(text) == 1)).otherwise(0.0),
    ]
    return [c.cast("double") for c in made + [flag(around.rlike(p)) for p in CONTEXT.values()]]


@dataclass
class Model:
    """Trees as (weight, node), a node being a value or (feature, threshold, left, right)."""

    trees: list[tuple[float, object]]
    thresholds: dict[str, float]

    def probability(self, span: Column) -> Column:
        names = [f"f{i}" for i in range(len(FEATURES))]

        def value(node, f: Column) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            at, threshold, left, right = node
            return F.when(f[names[at]] <= threshold, value(left, f)).otherwise(value(right, f))

        def total(f: Column) -> Column:
            margin = F.lit(0.0)
            for weight, node in self.trees:
                margin = margin + value(node, f) * weight
            return 1 / (1 + F.exp(-2 * margin))

        return let(F.struct(*[c.alias(n) for c, n in zip(described(span), names)]), total)


def examples(spark: SparkSession, each: int = PER_EXAMPLE) -> DataFrame:
    """(s, label, learn) of the formats, each filled in ``each`` times; ``learn`` is false for those left out."""
    seen: dict[tuple, int] = {}
    rows = []
    for kind, label, before, form, after in EXAMPLES:
        nth = seen[kind, label] = seen.get((kind, label), -1) + 1
        rows.append((kind, KINDS.index(kind), label, nth % HELD_OUT != HELD_OUT - 1, before, form, after))
    names = ("kind", "rank", "label", "learn", "left", "form", "right")
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])
    filled = spark.range(len(rows) * each).select("id", F.get(table, (F.col("id") % len(rows)).cast("int")).alias("e"))
    noise = F.sha2(F.concat(F.lit("digits-"), F.col("id").cast("string")), 512)
    digits, small = F.translate(noise, "abcdef", "314159"), F.translate(noise, "0123456789", "ghijklmnop")

    def fill(c: Column, i: Column) -> Column:
        of = lambda letters: F.substring(letters, i + 1, F.lit(1))
        return F.when(c == "#", of(digits)).when(c == "?", of(small)).when(c == "^", F.upper(of(small))).when(c == "%", F.lit("0")).otherwise(c)

    text = F.array_join(F.transform(F.split("e.form", ""), fill), "")
    check = lambda t: F.concat(F.left(t, F.lit(2)), F.lpad((98 - account_rest(t)).cast("string"), 2, "0"), F.substr(t, F.lit(5)))
    text = let(text, lambda t: F.when(F.col("e.form").contains("%%"), check(t)).otherwise(t))
    span = F.struct("e.rank", F.lit(0).alias("start"), F.length("e.form").alias("end"), "e.kind", text.alias("text"), "e.left", "e.right")
    return filled.select(span.alias("s"), F.col("e.label").cast("double").alias("label"), F.col("e.learn").alias("learn"))


def _labelled(certain: Column, s: Column) -> Column:
    """What a check can tell of a proposal: 1 personal, 0 not, null unknown."""
    digits = digits_of(s["text"])
    part = F.exists(certain, lambda b: b["kind"].isin("phone", "card") & (b["start"] < s["end"]) & (s["start"] < b["end"]))
    thing = book_number(digits) | ((F.length(digits) >= 13) & ~luhn(digits) & ~s["left"].rlike(CONTEXT["phone"]) & ~s["left"].rlike(CONTEXT["person"]))
    return (
        F.when(s["kind"] == "account", F.when(account_rest(s["text"]) == 1, 1.0).otherwise(0.0))
        .when((s["kind"] == "number") & part, 1.0)
        .when((s["kind"] == "number") & thing, 0.0)
    )


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(s, label, learn) of the spans of all documents with an id, where a check can tell."""
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.coalesce(text_col, F.lit("")).alias("t"))
    shapes = texts.select("t", shaped(F.col("t")).alias("f"))
    certain = shapes.select(F.explode("f").alias("s")).select("s", F.when(checked(F.col("s")), 1.0).otherwise(0.0).alias("label"))
    # A lone digit group that is no card has the shape by accident; it teaches nothing.
    certain = certain.filter((F.col("label") == 1) | (F.length(digits_of(F.col("s.text"))) >= 7))
    sure = shapes.select(F.filter("f", checked).alias("sure"), F.explode(proposals(F.col("t"))).alias("s"))
    proposed = sure.select("s", _labelled(F.col("sure"), F.col("s")).alias("label")).filter("label is not null")
    learn = F.pmod(F.xxhash64("s.text", "s.left"), F.lit(HELD_OUT)) != 0
    return certain.unionByName(proposed).withColumn("learn", learn)


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int | None = None) -> DataFrame:
    """(s, label, learn) of labelled spans: of ``max_docs`` documents, without it of all, and of the formats."""
    if max_docs is not None:
        ids = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
        docs = docs.join(F.broadcast(ids.distinct()), F.col(id_col) == F.col("_id"), "left_semi")
    return labelled(docs, id_col, text_col).unionByName(examples(docs.sparkSession))


def tallied(spans: DataFrame) -> DataFrame:
    """(s, label, learn, n): one span for all that are described alike, and their number."""
    names = [f"f_{n}" for n in FEATURES]
    told = spans.select("s", "label", "learn", *[c.alias(n) for c, n in zip(described(F.col("s")), names)])
    return told.groupBy("label", "learn", *names).agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("n")).select("s", "label", "learn", "n")


def fit_trees(rows: DataFrame):
    """The fitted classifier and its trees as (weight, node); a row counts as its ``weight`` says, without one as 1."""
    names = [f"f_{n}" for n in FEATURES]
    rows = rows if "weight" in rows.columns else rows.withColumn("weight", F.lit(1.0))
    described_rows = rows.filter("learn").select("label", "weight", *[c.alias(n) for c, n in zip(described(F.col("s")), names)])
    learn = VectorAssembler(inputCols=names, outputCol="features").transform(described_rows).select("label", "weight", "features")
    learn = learn.coalesce(max(2, rows.count() // ROWS_PER_TASK))
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=32, weightCol="weight").fit(learn)

    def node(n) -> object:
        if n.getClass().getSimpleName() == "LeafNode":
            return float(n.prediction())
        split = n.split()
        return int(split.featureIndex()), float(split.threshold()), node(n.leftChild()), node(n.rightChild())

    return fitted, [(float(w), node(t._call_java("rootNode"))) for w, t in zip(fitted.treeWeights, fitted.trees)]


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight_docs: int = WEIGHT_DOCS, precision: float = PRECISION
) -> Model:
    """Trees and thresholds from the labelled spans of all documents and from the formats."""
    share = min(1.0, weight_docs / max(1, docs.filter(F.col(id_col).isNotNull()).count()))
    found = tallied(labelled(docs, id_col, text_col)).withColumn("weight", F.col("n") * share).drop("n")
    rows = written(found.unionByName(examples(docs.sparkSession).withColumn("weight", F.lit(1.0))), "pii-spans")
    model = Model(fit_trees(rows)[1], {})
    # Scores of what was left out, as at most 101 sums for each kind.
    span = F.col("s")
    bins = rows.filter("not learn").select(span["kind"].alias("kind"), "label", "weight", F.floor(model.probability(span) * 100).cast("int").alias("p"))
    counts = bins.groupBy("kind", "p").agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("all")).collect()
    for kind in PROPOSED:
        own = sorted((r for r in counts if r["kind"] == kind), key=lambda r: -r["p"])
        good = total = 0
        best = 1.01
        for r in own:
            good, total = good + r["good"], total + r["all"]
            if good >= precision * total:
                best = r["p"] / 100
        model.thresholds[kind] = max(best, 0.5)
    return model


def find_personal_data(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``pii``, in place of a column of that name: (rank, start, end, kind), by kind, then position."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "pii"]
    slim = lambda a: F.transform(a, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    threshold = lambda s: F.coalesce(*[F.when(s["kind"] == k, t) for k, t in model.thresholds.items()], F.lit(1.01))
    text = F.coalesce(F.col(text_col), F.lit(""))

    inside = lambda s, b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]) & (b["end"] - b["start"] > s["end"] - s["start"])

    def together(certain: Column) -> Column:
        chosen = F.filter(proposals(text), lambda s: model.probability(s) >= threshold(s))
        apart = lambda c: F.filter(
            c,
            lambda s: ~F.exists(certain, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])) & ~F.exists(c, lambda b: inside(s, b)),
        )
        return F.concat(certain, let(slim(chosen), apart))

    return docs.select(*keep, let(slim(F.filter(shaped(text), checked)), together).alias("pii"))
