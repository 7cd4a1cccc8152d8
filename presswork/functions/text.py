"""Text functions.  All are column expressions that run inside the JVM, row by row,
without a shuffle."""

from __future__ import annotations

import html
import re
import string
from collections.abc import Iterable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params
from .core import NON_SPACE, SPACE, col, is_in, let, rfind, small_map, strip, string_array, text_or_empty, word_count, words

# fixed values: patterns
URL_PATTERN = rf"https?{NON_SPACE}+|www\.{NON_SPACE}+"
EMAIL_PATTERN = rf"{NON_SPACE}+@{NON_SPACE}+\.{NON_SPACE}+"
SENTENCE_BREAK = r"(?<=[.!?])\s+"
CLAUSE_BREAK = r"[,;:]\s+"
TAG_PATTERN = r"<[a-zA-Z/!?][^>]*>"
HIDDEN_PATTERN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
LINE_OR_GAP = r"\R|[\x1c-\x1e]|  "

#: Names of character references, and those that also count without a semicolon: the
#: standard's list, as the standard library has it.
ENTITIES = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
OLD_ENTITIES = [k for k in html5 if not k.endswith(";")]

#: What numbers of control characters stand for.
CONTROLS = {str(n): html.unescape(f"&#{n};") for n in (*range(0x20), *range(0x7F, 0xA0))}


# --------------------------------------------------------------------------- markup


def _char(digits: Column, base: int) -> Column:
    """The character that a number stands for; NULL without digits."""
    digits = F.when(digits != "", F.concat(F.lit("0"), F.ltrim(digits, F.lit("0"))))
    point = F.conv(digits, base, 10).cast("int")
    unknown = (F.length(digits) > 8) | (point > 0x10FFFF) | point.between(0xD800, 0xDFFF)
    unused = point.between(0xFDD0, 0xFDEF) | ((point % 0x10000) >= 0xFFFE)
    plain = F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32")
    return (
        F.when(unknown, F.lit("\ufffd"))
        .when(unused, F.lit(""))
        .otherwise(F.coalesce(F.try_element_at(small_map(CONTROLS), point.cast("string")), plain))
    )


def _decode_piece(piece: Column) -> Column:
    """Decode what follows one ``&``: a number, a name, or an old name without semicolon."""
    dec = F.regexp_extract(piece, "^#([0-9]+)", 1)
    hexa = F.regexp_extract(piece, "^#[xX]([0-9a-fA-F]+)", 1)
    name = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]{1,30});", 1)
    old = F.regexp_extract(piece, "^(" + "|".join(sorted(OLD_ENTITIES, key=len, reverse=True)) + ")", 1)
    named = small_map(ENTITIES)
    rest = lambda pattern: F.regexp_replace(piece, pattern, "")
    number = F.when(dec != "", _char(dec, 10)).when(hexa != "", _char(hexa, 16))
    return F.coalesce(
        F.when(
            piece.startswith("#"),
            F.concat(number, rest(r"^#([0-9]+|[xX][0-9a-fA-F]+);?")),
        ),
        F.concat(F.try_element_at(named, name), rest(r"^[A-Za-z0-9]+;")),
        F.concat(F.try_element_at(named, old), F.substr(piece, F.length(old) + 1)),
        F.concat(F.lit("&"), piece),
    )


def decode_entities(c: Column | str) -> Column:
    """Decode character references in one pass (``&amp;lt;`` gives ``&lt;``)."""

    def decode(x: Column) -> Column:
        decoded = let(
            F.split(x, "&", -1),
            lambda p: F.concat(
                F.get(p, F.lit(0)),
                F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p)), _decode_piece), ""),
            ),
        )
        return F.when(x.contains("&"), decoded).otherwise(x)

    return let(col(c), decode)


def strip_tags(c: Column | str, separator: str = "") -> Column:
    """Text outside tags, comments, scripts and styles."""

    def bare(x: Column) -> Column:
        shown = F.regexp_replace(x, HIDDEN_PATTERN, separator)
        return F.when(x.contains("<"), F.regexp_replace(shown, TAG_PATTERN, separator)).otherwise(x)

    return let(col(c), bare)


def html_to_text(c: Column | str, decode=decode_entities) -> Column:
    """Readable text of a page: one stripped, non-blank chunk per line."""
    chunks = F.split(decode(strip_tags(text_or_empty(c))), LINE_OR_GAP, -1)
    return F.array_join(F.filter(F.transform(chunks, strip), lambda x: x != ""), "\n")


# --------------------------------------------------------------------------- cleaning


def clean_text(c: Column | str, decode=decode_entities) -> Column:
    """Lower-case ASCII words only: no markup, links, addresses, punctuation or digits."""
    # the guards spare most texts the backtracking patterns
    def without(pattern: str, *signs: str):
        def step(x: Column) -> Column:
            present = x.contains(signs[0])
            for sign in signs[1:]:
                present = present | x.contains(sign)
            return F.when(present, F.regexp_replace(x, pattern, "")).otherwise(x)

        return step

    x = decode(strip_tags(decode(text_or_empty(c)), " "))
    x = let(x, without(URL_PATTERN, "http", "www."))
    x = let(x, without(EMAIL_PATTERN, "@"))
    x = F.regexp_replace(x, r"[^\x00-\x7F]+", " ")
    x = F.translate(F.lower(x), string.punctuation + string.digits, "")
    return F.trim(F.regexp_replace(x, r"[\s\x1c-\x1f]+", " "))


def remove_stopwords(c: Column | str, stopwords: Iterable[str] = params.STOPWORDS) -> Column:
    stop = list(stopwords)
    return F.array_join(F.filter(words(text_or_empty(c)), lambda w: ~is_in(F.lower(w), stop)), " ")


def quote_phrase(c: Column | str) -> Column:
    """Quote a search of several words unless it is quoted already."""
    c = col(c)
    quoted = c.startswith('"') & c.endswith('"')
    return F.when(c.contains(" ") & ~quoted, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)


def slug(c: Column | str) -> Column:
    """File-name form of a title."""
    safe = F.regexp_replace(strip(c), r"[^\p{L}\p{N} _-]", "_")
    return F.lower(F.replace(safe, F.lit(" "), F.lit("_")))


def cache_key(c: Column | str) -> Column:
    """Name stem of a sector's snapshot file."""
    return F.replace(F.lower(col(c)), F.lit(" "), F.lit("_"))


# --------------------------------------------------------------------------- sentences


def split_sentences(c: Column | str) -> Column:
    return F.split(col(c), SENTENCE_BREAK, -1)


def count_sentences(c: Column | str) -> Column:
    """Non-blank stretches between ``.``, ``!`` and ``?``."""
    parts = F.split(F.translate(text_or_empty(c), "!?", ".."), r"\.", -1)
    return F.size(F.filter(parts, lambda p: strip(p) != ""))


def paragraphs(c: Column | str) -> Column:
    return F.split(col(c), "\n\n", -1)


def sentence_pieces(sentence: Column) -> Column:
    """What a sentence adds to a summary: itself with 5-50 words, its clauses if it is longer
    and each of them has 5-30 words, else nothing."""

    def clauses(parts: Column) -> Column:
        fits = (F.size(parts) > 1) & F.forall(parts, lambda p: word_count(p).between(5, 30))
        return F.when(fits, parts).otherwise(F.array().cast("array<string>"))

    def pieces(bare: Column) -> Column:
        return let(
            word_count(bare),
            lambda n: F.when(n < 5, F.array().cast("array<string>"))
            .when(n <= 50, F.array(bare))
            .otherwise(let(F.split(bare, CLAUSE_BREAK, -1), clauses)),
        )

    return let(strip(sentence), pieces)


def usable_sentences(content: Column | str) -> Column:
    """Sentences of 5-50 words; longer ones only as clauses of 5-30 words each."""
    return F.flatten(F.transform(split_sentences(content), sentence_pieces))


def top_up(partial: Column, rest: Column, target: int = 15) -> Column:
    """A summary of too few sentences with more of them from the text that follows."""

    def with_more(more: Column) -> Column:
        need = F.lit(target) - F.size(F.split(partial, r"\. ", -1))
        take = F.when(need >= 0, need).otherwise(F.greatest(F.size(more) + need, F.lit(0)))
        return strip(F.concat_ws(" ", partial, F.array_join(F.slice(more, F.lit(1), take), " ")))

    return let(split_sentences(rest), with_more)


def cut_head(head: Column) -> Column:
    """The beginning of a text up to its last full stop, if that does not come too early."""
    return F.when(rfind(head, ".") > 500, F.substr(head, F.lit(1), rfind(head, ".") + 1)).otherwise(head)


def enhance_summary(summary: Column | str, content: Column | str, target: int = 15) -> Column:
    """A summary of ``target`` usable sentences, with fallbacks for thin articles."""
    summary, content = text_or_empty(summary), text_or_empty(content)

    def unusable() -> Column:
        long_ones = F.filter(paragraphs(content), lambda p: word_count(p) > 10)
        return let(
            long_ones,
            lambda ps: F.when(F.size(ps) > 0, F.array_join(F.slice(ps, 1, 5), " ")).otherwise(cut_head(F.substring(content, 1, 2000))),
        )

    def from_sentences(kept: Column) -> Column:
        rest = lambda partial: F.substr(content, F.length(partial) + 1, F.lit(1000))
        return (
            F.when(F.size(kept) >= target, F.array_join(F.slice(kept, 1, target), " "))
            .when(F.size(kept) > 0, let(F.array_join(kept, " "), lambda partial: top_up(partial, rest(partial), target)))
            .otherwise(unusable())
        )

    empty = F.when(F.length(summary) > 20, summary).otherwise(F.lit(params.NO_SUMMARY_TEXT))
    return F.when(content == "", empty).otherwise(let(usable_sentences(content), from_sentences))


def cut_at_sentence(c: Column | str, max_sentences: int = 15, max_chars: int = 1200) -> Column:
    """The first sentences, cut back to the last full stop if too long."""

    def cut(joined: Column) -> Column:
        head = F.substring(joined, 1, max_chars)
        at_stop = let(
            rfind(head, "."),
            lambda p: F.when(p > 0, F.substr(head, F.lit(1), p + 1)).otherwise(head),
        )
        return F.when(F.length(joined) > max_chars, at_stop).otherwise(joined)

    return let(F.array_join(F.slice(split_sentences(text_or_empty(c)), 1, max_sentences), " "), cut)


def drop_boilerplate(sentences: Column, phrases: Iterable[str] = params.BOILERPLATE) -> Column:
    """Sentences that hold none of the phrases, ignoring case."""
    phrases = [p.lower() for p in phrases]

    def clean(sentence: Column) -> Column:
        def holds_any(low: Column) -> Column:
            found = F.lit(False)
            for p in phrases:
                found = found | low.contains(p)
            return found

        return ~let(F.lower(sentence), holds_any)

    return F.filter(sentences, clean)


def display_sentences(
    summary: Column | str,
    content: Column | str,
    phrases: Iterable[str] = params.BOILERPLATE,
    minimum: int = params.MIN_CARD_SENTENCES,
) -> Column:
    """Sentences fit for a card, or NULL when the article has to be rejected."""
    phrases = list(phrases)
    summary, content = text_or_empty(summary), text_or_empty(content)
    main = F.when(F.length(content) > F.length(summary), content).otherwise(
        F.when(summary != "", summary).otherwise(F.lit(params.NO_CONTENT_TEXT))
    )
    other = F.when(summary != "", summary).otherwise(content)

    def kept(text: Column) -> Column:
        return drop_boilerplate(split_sentences(text), phrases)

    def enough(xs: Column) -> Column:
        return F.size(xs) >= minimum

    return let(
        kept(main),
        lambda a: F.when(enough(a), a).otherwise(let(kept(other), lambda b: F.when(enough(b), b))),
    )


def display_content(
    summary: Column | str,
    content: Column | str,
    phrases: Iterable[str] = params.BOILERPLATE,
    minimum: int = params.MIN_CARD_SENTENCES,
    maximum: int = params.MAX_CARD_SENTENCES,
) -> Column:
    """Card text; NULL when fewer than ``minimum`` sentences are left."""
    return let(
        display_sentences(summary, content, phrases, minimum),
        lambda s: F.concat(
            strip(F.array_join(F.slice(s, 1, maximum), " ")),
            F.when(F.size(s) > maximum, F.lit(" ...")).otherwise(F.lit("")),
        ),
    )


# --------------------------------------------------------------------------- tokens


def token_text(c: Column | str, lower: bool = True) -> Column:
    """Tokens (words and single punctuation marks) between blanks, with a blank at both
    ends, so that a phrase occurs exactly when ``' phrase '`` is contained."""
    c = text_or_empty(c)
    spaced = F.regexp_replace(F.lower(c) if lower else c, r"[^\p{L}\p{N}\s]", " $0 ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(spaced, r"\s+", " ")), F.lit(" "))


def first_tokens(c: Column | str, n: int) -> Column:
    """The first ``n`` tokens of ``token_text``, without making the others."""
    pattern = rf"^(?:\s*+(?:[\p{{L}}\p{{N}}]++|[^\p{{L}}\p{{N}}\s])){{0,{n}}}+"
    head = F.regexp_extract(F.lower(text_or_empty(c)), pattern, 0)
    return F.split(F.trim(token_text(head, lower=False)), " ", -1)


def word_tokens(c: Column | str, lower: bool = True) -> Column:
    """Runs of letters and digits."""
    c = text_or_empty(c)
    return F.regexp_extract_all(F.lower(c) if lower else c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def first_words(c: Column | str, n: int, lower: bool = True) -> Column:
    """The first ``n`` of ``word_tokens``, without making the others."""
    pattern = rf"^(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]++){{0,{n}}}+"
    c = text_or_empty(c)
    return word_tokens(F.regexp_extract(F.lower(c) if lower else c, pattern, 0), lower=False)


def token_form(term: str, lower: bool = True) -> str:
    """A term as ``token_text`` writes it, without the outer blanks."""
    return " ".join(re.sub(r"([^\w\s]|_)", r" \1 ", term.lower() if lower else term).split())


def contains_term(padded: Column, term: str) -> Column:
    return padded.contains(f" {token_form(term)} ") if token_form(term) else F.lit(False)


def candidate_phrases(
    c: Column | str, stopwords: Iterable[str] = params.STOPWORDS, longest: int | None = None
) -> Column:
    """Runs of words between stop words and punctuation (Rose et al. 2010).

    ``longest`` leaves out longer runs; by default all count.
    """
    stop = list(stopwords)
    tokens = F.split(F.trim(token_text(c)), " ", -1)
    marked = F.transform(
        tokens,
        lambda t: F.when(is_in(t, stop) | t.rlike(r"^[^\p{L}\p{N}]"), F.lit("|")).otherwise(t),
    )
    runs = F.split(F.array_join(marked, " "), r"\|", -1)
    return F.filter(
        F.transform(runs, lambda r: F.trim(r)),
        lambda r: (r != "") & ((F.size(F.split(r, " ")) <= longest) if longest else F.lit(True)),
    )


__all__ = [
    "candidate_phrases", "clean_text", "contains_term", "count_sentences", "cut_at_sentence",
    "decode_entities", "display_content", "display_sentences",
    "drop_boilerplate", "enhance_summary", "html_to_text", "paragraphs", "quote_phrase",
    "remove_stopwords", "slug", "cache_key", "sentence_pieces", "split_sentences", "strip_tags", "string_array",
    "token_text", "usable_sentences", "word_tokens",
]
