"""Raw web pages and the articles in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import col, let, strip
from ..functions.text import HIDDEN_PATTERN, decode_entities, html_to_text, strip_tags


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages: at least ``url`` and ``html``."""
    return spark.read.parquet(path)


# fixed values: patterns
_QUOTED = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
HEAD_TAG = rf"(?is)<(?:html|meta)(?=[\s/>]){_QUOTED}>"
ARTICLE_TAG = rf"(?is)<(/?)article(?=[\s/>]){_QUOTED}>"
ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


def _shown(html: Column) -> Column:
    """Markup without comments, scripts and styles."""
    return F.regexp_replace(html, HIDDEN_PATTERN, "")


def head_tags(shown: Column) -> Column:
    """The ``html`` and ``meta`` tags of a page as (tag, names, values), in any order and quoting.

    Names are in lower case; of an attribute given twice the first counts.
    """
    unquoted = lambda v: F.when(v.rlike("^[\"']"), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)

    def read(tag: Column) -> Column:
        body = F.regexp_replace(tag, "^<[a-zA-Z]+|>$", "")
        name = F.lower(F.regexp_extract(tag, "^<([a-zA-Z]+)", 1))
        names = F.transform(F.regexp_extract_all(body, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
        values = F.transform(F.regexp_extract_all(body, F.lit(ATTRIBUTE), F.lit(2)), unquoted)
        return F.struct(name.alias("tag"), names.alias("names"), values.alias("values"))

    return F.transform(F.regexp_extract_all(shown, F.lit(HEAD_TAG), F.lit(0)), read)


def _attribute(tag: Column, name: str) -> Column:
    return F.get(tag["values"], F.array_position(tag["names"], F.lit(name)).cast("int") - 1)


def _meta(tags: Column, name: str) -> Column:
    """Raw content of the first ``<meta>`` of this name or property that has any; '' when there is none."""

    def mine(tag: Column) -> Column:
        named = (F.lower(_attribute(tag, "name")) == name) | (F.lower(_attribute(tag, "property")) == name)
        return F.coalesce((tag["tag"] == "meta") & named & (_attribute(tag, "content") != ""), F.lit(False))

    return F.coalesce(let(F.get(F.filter(tags, mine), F.lit(0)), lambda tag: _attribute(tag, "content")), F.lit(""))


def _lang(tags: Column) -> Column:
    own = lambda tag: F.when(tag["tag"] == "html", F.coalesce(_attribute(tag, "lang"), _attribute(tag, "xml:lang")))
    return F.coalesce(F.get(F.filter(F.transform(tags, own), lambda x: x != ""), F.lit(0)), F.lit("en"))


def article_markup(shown: Column) -> Column:
    """Inside of the longest ``<article>`` that is in no other one; NULL without a closed one."""

    def chosen(parts: Column) -> Column:
        def step(at: Column, i: Column) -> Column:
            # parts[i] is followed by the i-th mark, "/" if it closes
            closes = F.get(marks, i) == "/"
            depth = F.when(closes, F.greatest(at["depth"] - 1, F.lit(0))).otherwise(at["depth"] + 1)
            ends = closes & (at["depth"] == 1)
            span = F.struct(at["start"].alias("from"), i.alias("to"))
            return F.struct(
                depth.alias("depth"), F.when(~closes & (at["depth"] == 0), i + 1).otherwise(at["start"]).alias("start"),
                F.when(ends, F.concat(at["spans"], F.array(span))).otherwise(at["spans"]).alias("spans"),
            )

        begun = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("start"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))
        spans = F.aggregate(F.sequence(F.lit(0), F.size(parts) - 2), begun, step, lambda at: at["spans"])
        inner = F.transform(
            spans,
            lambda s, i: let(
                F.array_join(F.slice(parts, s["from"] + 1, s["to"] - s["from"] + 1), ""),
                lambda t: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t")),
            ),
        )
        return F.when(F.size(parts) > 1, F.array_max(inner)["t"])

    marks = F.regexp_extract_all(shown, F.lit(ARTICLE_TAG), F.lit(1))
    return let(F.split(shown, ARTICLE_TAG, -1), chosen)


def page_text(html: Column | str) -> Column:
    """Text of the page's main ``<article>`` element, of the whole page if it has none."""
    html = col(html)
    return html_to_text(let(_shown(html), lambda shown: F.coalesce(article_markup(shown), shown)))


#: Metadata read from a page's head.
META = [
    "description", "og:description", "article:published_time", "author", "keywords", "og:image",
]


def normalize_pages(df: DataFrame) -> DataFrame:
    """Pages as article rows."""
    html = F.col("html")

    def head(shown: Column) -> Column:
        title = strip_tags(F.regexp_extract(shown, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))
        read = lambda tags: F.struct(
            F.transform(F.array(title, *[_meta(tags, name) for name in META]), decode_entities).alias("texts"), _lang(tags).alias("lang")
        )
        return let(head_tags(shown), read)

    site = F.try_parse_url(F.col("url"), F.lit("HOST"))
    rest = [c for c in df.columns if c not in ("url", "html")]
    # one array, so that the decoder appears once in the plan
    staged = df.select(
        *rest, "url", let(_shown(F.coalesce(html, F.lit(""))), head).alias("_h"), page_text(html).alias("content"),
        F.coalesce(site, F.lit("Unknown")).alias("source_name"),
    )
    staged = staged.withColumns({"lang": F.col("_h.lang"), "_h": F.col("_h.texts")})
    head = {name: F.get("_h", F.lit(i)) for i, name in enumerate(["title", *META])}
    found = {name: F.when(c != "", c) for name, c in head.items()}
    none = F.array().cast("array<string>")
    return staged.select(
        *rest,
        "url",
        strip(head["title"]).alias("title"),
        "content",
        F.coalesce(found["description"], found["og:description"], F.lit("")).alias("description"),
        "source_name",
        "lang",
        head["article:published_time"].alias("published_raw"),
        F.when(head["author"] != "", F.array(head["author"])).otherwise(none).alias("authors"),
        F.filter(F.transform(F.split(head["keywords"], ","), strip), lambda k: k != "").alias("keywords"),
        found["og:image"].alias("image_url"),
    )
