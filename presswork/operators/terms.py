"""Matching article text against term tables: categories, entities, lemmas."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import params
from ..functions import text as X
from ..functions.core import is_in, let, lookup, text_or_empty, words
from ..session import written
from ..sizing import INLINE_ROWS, inline_rows
from . import asking, trie
from .postings import phrase_hits, token_postings

# --------------------------------------------------------------------------- categories


def as_rows(table, limit: int) -> tuple[list[tuple] | None, DataFrame | list[tuple]]:
    """A parameter table as rows to inline, ``None`` if there are more than ``limit``, and as given."""
    if isinstance(table, dict):
        table = list(table.items())
    elif not isinstance(table, DataFrame):
        table = [tuple(r) for r in table]
    return inline_rows(table, limit), table


def as_table(spark, table: DataFrame | list[tuple], columns: str) -> DataFrame:
    """A parameter table as a DataFrame."""
    return table if isinstance(table, DataFrame) else spark.createDataFrame(table, columns)


def text_key(text: Column | str) -> Column:
    """What a text is joined by: rows with one text get one answer, whatever else they hold."""
    return F.sha2(text_or_empty(text), 256)


def taxonomy_dict(taxonomy, limit: int = 1_000) -> dict[str, list[str]] | None:
    """Taxonomy rows (category, term, ord) as an ordered dict; ``None`` if too many to inline.

    A category ranks by its smallest (ord, term) in the whole table.
    """
    if isinstance(taxonomy, dict):
        return taxonomy if sum(map(len, taxonomy.values())) <= limit else None
    rows, _ = as_rows(taxonomy, limit)
    if rows is None:
        return None
    out: dict[str, list[str]] = {}
    for category, term, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        out.setdefault(category, []).append(term)
    return out


def categories(text: Column | str, taxonomy: dict[str, list[str]] = params.TAXONOMY) -> Column:
    """Categories with a term in the text as whole words, ignoring case; taxonomy order."""

    def found(padded: Column) -> Column:
        per_category = []
        for category, terms in taxonomy.items():
            hit = F.lit(False)
            for term in terms:
                hit = hit | X.contains_term(padded, term)
            per_category.append(F.when(hit, F.lit(category)))
        return F.array_compact(F.array(*per_category))

    return let(X.token_text(text), found)


def match_categories(df: DataFrame, taxonomy=params.TAXONOMY, text: str = "content", out: str = "categories", limit: int = 1_000, trie_limit: int | None = None) -> DataFrame:
    """Add ``categories``; ``taxonomy`` is a dict or rows or a table (category, term, ord).

    Up to ``limit`` terms are compared one by one, up to ``trie_limit`` (by default
    ``trie.TRIE_ROWS``) by walking a table of all of them; both in place, without a shuffle.
    Of a still larger table blocks of texts ask for what they may have (``asking.py``), and the
    answer is joined back by the text.  All ways give the same result.
    """
    inline = taxonomy_dict(taxonomy, limit)
    if inline is not None:
        return df.withColumn(out, categories(text, inline))
    if isinstance(taxonomy, dict):
        taxonomy = [(c, t, i) for i, (c, ts) in enumerate(taxonomy.items()) for t in ts]
    table = as_table(df.sparkSession, as_rows(taxonomy, 0)[1], "category string, term string, ord int")
    # what the table is made of is not read again for the ranks
    table = written(table.select("category", "term", "ord"), "taxonomy-rows")
    ranks = table.groupBy("category").agg(F.min(F.struct("ord", "term")).alias("rank"))
    terms = table.select("category", F.trim(X.token_text("term")).alias("phrase")).filter("phrase != ''").distinct()
    terms = written(terms.join(ranks, "category").select("phrase", F.struct("rank", "category").alias("value")), "taxonomy")
    joined = F.trim(X.token_text(text))
    tokens, none = F.split(joined, " ", -1), F.array().cast("array<string>")
    if trie.fits(terms, trie_limit):
        placed, names = _placed(terms)
        return df.withColumn(out, trie.named(placed, tokens, names))
    # names may be shipped, as of a table that fits
    if trie.fits(terms.select("value").distinct()):
        return _answered(df, text, _categories_by_asking(df, text, joined, terms), out, none)
    hits = phrase_hits(token_postings(df.withColumn("_k", text_key(text)), "_k", {"text": tokens}), terms)
    found = (
        hits.join(terms, "phrase")
        .groupBy(F.col("id").alias("_k"))
        .agg(F.sort_array(F.collect_set("value")).alias("_c"))
        .select("_k", F.col("_c.category").alias("_found"))
    )
    return _answered(df, text, found, out, none)


def _placed(terms: DataFrame) -> tuple[DataFrame, pa.Array]:
    """Terms with their category's place in the taxonomy's order, and the names in that order."""
    # of categories there are at most as many as rows that fit
    names = terms.select("value").distinct().orderBy("value").toArrow()["value"].combine_chunks().field("category")
    places = terms.sparkSession.createDataFrame(pa.table({"category": names, "_place": pa.array(range(len(names)), pa.int32())}))
    return terms.select("phrase", F.col("value.category").alias("category")).join(places, "category").select("phrase", F.col("_place").alias("value")), names


def _categories_by_asking(df: DataFrame, text: str, joined: Column, terms: DataFrame) -> DataFrame:
    """(_k, _found): the names of the categories of each text that has any."""
    placed, names = _placed(terms)
    shared = df.sparkSession.sparkContext.broadcast(names)

    def made(n, owner, number, first, places, phrases) -> pa.Array:
        owner, place = asking.values(owner, number, first, places)
        return trie._listed(owner, n, shared.value.take(pa.array(place)), pa.list_(pa.string()))

    found = asking.found(df.select(text_key(text).alias("id"), joined.alias("_text")), F.col("_text"), written(placed.withColumnRenamed("value", "place"), "placed-terms"), made, T.ArrayType(T.StringType()))
    return found.select(F.col("id").alias("_k"), F.col("found").alias("_found"))


def _answered(df: DataFrame, text: str, found: DataFrame, out: str, none: Column, read: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """``df`` with the answers of a table (_k, _found), joined by the text and then read by ``read``."""
    kept = [c for c in df.columns if c != out]
    keyed = df.withColumn("_k", text_key(text))
    return keyed.join(found, "_k", "left").select(*kept, F.coalesce(read(F.col("_found")), none).alias(out))


def primary_category(cats: Column | str) -> Column:
    return F.coalesce(F.get(F.col(cats) if isinstance(cats, str) else cats, F.lit(0)), F.lit("other"))


# --------------------------------------------------------------------------- entities


def entity_surfaces(entity_dict, limit: int = INLINE_ROWS) -> dict[str, str] | None:
    """Dictionary rows (surface, label) as surface -> label, surfaces in token form.

    Of surfaces with one token form the first in the alphabet decides.
    """
    rows, _ = as_rows(entity_dict, limit)
    if rows is None:
        return None
    out = {}
    for surface, label in sorted(rows):
        token_form = " ".join(re.findall(r"[^\W_]+", surface))
        if token_form and label in params.ENTITY_LABELS:
            out.setdefault(token_form, label)
    return out


MENTIONS = "array<struct<pos:int,surface:string>>"


def mentions_in(tokens: Column, surfaces: dict[str, str] | Column) -> Column:
    """Every known surface among the tokens as (pos, surface), in text order.

    ``surfaces`` is a dictionary folded into the plan, or an array column that holds
    the surfaces of this row.
    """
    if isinstance(surfaces, Column):
        return _mentions_of_row(tokens, surfaces)
    by_length: dict[int, list[str]] = {}
    for s in surfaces:
        by_length.setdefault(s.count(" ") + 1, []).append(s)
    if not surfaces:
        return F.array().cast(MENTIONS)

    def of_length(n: int, names: list[str]) -> Column:
        firsts = sorted({s.split(" ")[0] for s in names})
        starts = F.filter(
            F.sequence(F.lit(1), F.size(tokens) - (n - 1)),
            lambda i: is_in(F.get(tokens, i - 1), firsts),
        )
        grams = F.transform(
            starts,
            lambda i: F.struct(
                i.alias("pos"), F.array_join(F.slice(tokens, i, F.lit(n)), " ").alias("surface")
            ),
        )
        hits = F.filter(grams, lambda g: is_in(g.surface, names)) if n > 1 else grams
        return F.when(F.size(tokens) >= n, hits).otherwise(F.array().cast(MENTIONS))

    found = [of_length(n, names) for n, names in sorted(by_length.items())]
    return F.sort_array(F.flatten(F.array(*found)))


def _mentions_of_row(tokens: Column, own: Column) -> Column:
    def n_words(s: Column) -> Column:
        return F.length(s) - F.length(F.translate(s, " ", "")) + 1

    def scan(names: Column) -> Column:
        longest = F.array_max(F.transform(names, n_words))

        def of_length(n: Column) -> Column:
            grams = F.transform(
                F.sequence(F.lit(1), F.size(tokens) - n + 1),
                lambda i: F.struct(
                    i.alias("pos"), F.array_join(F.slice(tokens, i, n), " ").alias("surface")
                ),
            )
            hits = F.filter(grams, lambda g: F.array_contains(names, g.surface))
            return F.when(F.size(tokens) >= n, hits).otherwise(F.array().cast(MENTIONS))

        every = F.flatten(F.transform(F.sequence(F.lit(1), longest), of_length))
        return F.when(F.size(names) > 0, F.sort_array(every)).otherwise(F.array().cast(MENTIONS))

    return let(own, scan)


def entity_mentions(text: Column | str, surfaces: dict[str, str] | Column) -> Column:
    """Every known surface in the text, case-sensitive, as (pos, surface) in text order."""
    if isinstance(surfaces, dict) and not surfaces:
        return F.array().cast(MENTIONS)
    return let(X.word_tokens(text, lower=False), lambda tokens: mentions_in(tokens, surfaces))


def surfaces_of(ents: Column, labels: Iterable[str] = params.ENTITY_LABELS) -> Column:
    """Surfaces in an entity map under any of the labels."""
    wanted = F.map_filter(ents, lambda label, _: is_in(label, labels))
    return F.flatten(F.map_values(wanted))


def _by_label(hits: Column, names_of) -> Column:
    """Map of label to distinct surfaces; ``names_of`` gives those of a label in text order, or None."""
    entries = []
    for label in params.ENTITY_LABELS:
        names = names_of(hits, label)
        if names is not None:
            entries.append(F.struct(F.lit(label).alias("key"), F.array_distinct(names).alias("value")))
    if not entries:
        return F.create_map().cast("map<string,array<string>>")
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e.value) > 0))


def entities(text: Column | str, surfaces: dict[str, str]) -> Column:
    """Map of label to distinct surfaces in order of first mention; labels found only."""

    def named(hits: Column, label: str) -> Column | None:
        own = [s for s, lab in surfaces.items() if lab == label]
        return F.transform(F.filter(hits, lambda h: is_in(h.surface, own)), lambda h: h.surface) if own else None

    return let(entity_mentions(text, surfaces), lambda hits: _by_label(hits, named))


def match_entities(df: DataFrame, entity_dict, text: str = "content", out: str = "entities", limit: int = INLINE_ROWS, trie_limit: int | None = None) -> DataFrame:
    """Add ``entities``, a map of label to surfaces.

    A dictionary of up to ``limit`` rows is folded into the plan, one of up to ``trie_limit``
    (by default ``trie.TRIE_ROWS``) is walked as a table; both in place, without a shuffle.  Of
    a still larger one blocks of texts ask for what they may have (``asking.py``), and the answer
    is joined back by the text.  All ways give the same result.
    """
    surfaces = entity_surfaces(entity_dict, limit)
    if surfaces is not None:
        return df.withColumn(out, entities(text, surfaces))
    table = as_table(df.sparkSession, as_rows(entity_dict, 0)[1], "surface string, label string")
    names = (
        table.filter(F.col("label").isin(params.ENTITY_LABELS))
        .select(F.array_join(X.word_tokens("surface", lower=False), " ").alias("phrase"), F.struct("surface", "label").alias("of"))
        .filter(F.col("phrase") != "")
        .groupBy("phrase")
        .agg(F.min("of")["label"].alias("value"))
    )
    rank = F.array_position(F.array(*[F.lit(x) for x in params.ENTITY_LABELS]), F.col("value")) - 1
    names = written(names.select("phrase", rank.cast("int").alias("value")), "entity-names")
    tokens, none = X.word_tokens(text, lower=False), F.create_map().cast("map<string,array<string>>")
    if trie.fits(names, trie_limit):
        return df.withColumn(out, _labelled(trie.first_hits(names, tokens, _names_by_label, T.ArrayType(_LABELLED))))
    asked = df.select(text_key(text).alias("id"), F.array_join(tokens, " ").alias("_text"))
    found = asking.found(asked, F.col("_text"), names.withColumnRenamed("value", "place"), _names_by_label, T.ArrayType(_LABELLED))
    return _answered(df, text, found.select(F.col("id").alias("_k"), F.col("found").alias("_found")), out, none, _labelled)


def _labelled(found: Column) -> Column:
    """A map of label to names; they come as one string a label, and are taken apart only here."""
    labels = F.array(*[F.lit(x) for x in params.ENTITY_LABELS])
    return F.map_from_entries(F.transform(found, lambda e: F.struct(F.get(labels, e["label"]), F.split(e["names"], "\n", -1))))


_LABELLED = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("names", T.StringType())])


def _names_by_label(n, owner, number, first, places, phrases) -> pa.Array:
    """For each text its labels, and the names of a label as one string, in text order."""
    size = len(params.ENTITY_LABELS)
    key = owner * size + places[first[number]]
    order = np.argsort(key, kind="stable")
    groups, count = np.unique(key, return_counts=True)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), phrases.take(pa.array(number[order])))
    return trie._listed(groups // size, n, [pa.array(groups % size, pa.int32()), pc.binary_join(lists, "\n")], to_arrow_type(T.ArrayType(_LABELLED)))


def mine_entities(df: DataFrame, min_df: int = 2, text: str = "content") -> DataFrame:
    """Capitalised words and runs of them with the number of articles they occur in.

    Each article counts a run once, and counts are combined per task before the shuffle,
    so a run found in every article costs one row per task.
    """
    runs = F.regexp_extract_all(
        text_or_empty(text), F.lit(r"\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+)*"), F.lit(0)
    )
    return (
        df.select(F.explode(F.array_distinct(runs)).alias("surface"))
        .groupBy("surface")
        .agg(F.count("*").alias("doc_count"))
        .filter(F.col("doc_count") >= min_df)
    )


# --------------------------------------------------------------------------- lemmas


def lemmatized(cleaned: Column | str, lemmas: dict[str, str], stopwords: Iterable[str] = params.STOPWORDS) -> Column:
    """Words of a cleaned text without stop words, each replaced by its lemma if known."""
    stop = list(stopwords)
    kept = F.filter(words(text_or_empty(cleaned)), lambda w: ~is_in(w, stop))
    return F.array_join(F.transform(kept, lambda w: F.coalesce(lookup(lemmas, w), w)), " ")


def lemmatize(df: DataFrame, lemma_dict, text: str = "cleaned_content", out: str = "lemmatized_content", stopwords: Iterable[str] = params.STOPWORDS, limit: int = INLINE_ROWS) -> DataFrame:
    """Add the lemmatised text; of several lemmas of a token the first in the alphabet counts.

    A dictionary of more than ``limit`` rows is joined per distinct word, with the same result.
    """
    stop = list(stopwords)
    rows, table = as_rows(lemma_dict, limit)
    if rows is not None:
        return df.withColumn(out, lemmatized(text, dict(sorted(rows, reverse=True)), stop))
    kept = F.filter(words(text_or_empty(text)), lambda w: ~is_in(w, stop))
    lemmas = as_table(df.sparkSession, table, "token string, lemma string").groupBy("token").agg(F.min("lemma").alias("lemma"))
    # distinct words only: the lemma of a word is joined once per text, whatever its count
    pairs = (
        df.select(text_key(text).alias("_k"), F.explode(F.array_distinct(kept)).alias("token"))
        .join(lemmas, "token")
        .groupBy("_k")
        .agg(F.map_from_entries(F.collect_set(F.struct("token", "lemma"))).alias("_found"))
    )
    joined = _answered(df, text, pairs, "_lemmas", F.create_map().cast("map<string,string>"))
    known = lambda w: F.coalesce(F.try_element_at(F.col("_lemmas"), w), w)
    return joined.withColumn(out, F.array_join(F.transform(kept, known), " ")).drop("_lemmas")


def clean_articles(df: DataFrame, lemma_dict=None, stopwords: Iterable[str] = params.STOPWORDS) -> DataFrame:
    """Add the cleaned form of each text field present, and two reduced forms of the content."""
    made = {f"cleaned_{c}": X.clean_text(c) for c in ("title", "content", "description") if c in df.columns}
    df = df.withColumns(made)
    if "content" not in df.columns:
        return df
    df = df.withColumn("content_no_stopwords", X.remove_stopwords("cleaned_content", stopwords))
    return lemmatize(df, lemma_dict or {}, stopwords=stopwords)
