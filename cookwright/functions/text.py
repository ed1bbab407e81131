"""Text functions as column expressions: folding, ingredient terms, durations, URLs, categories.

All stay inside the JVM but for HTML entities, for which Spark has no function.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cookwright.functions import words as W


def _plain(ch: str) -> str:
    """A character after case folding, decomposition and loss of its marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", ch.casefold()) if not unicodedata.combining(c))


# Latin letters and signs that decompose to one ASCII letter or digit are translated, by rule; those that become
# several are replaced one by one, for the signs that texts of this kind have.
_LATIN = [chr(c) for lo, hi in ((0xA0, 0x250), (0x1E00, 0x1F00), (0x2070, 0x20A0), (0xFF10, 0xFF5B)) for c in range(lo, hi)]
_ONE = {c: p for c in _LATIN if len(p := _plain(c)) == 1 and p.isascii() and p.isalnum()}
_MANY = {c: "".join(x if x.isascii() and x.isalnum() else " " for x in _plain(c)) for c in "ßẞ¼½¾⅓⅔⅛⅜⅝⅞™№ﬁﬂĳĲ㎏㎖"}
_COMBINING = "[\\u0300-\\u036f]"


def normalize(text: Column) -> Column:
    """Lower case ASCII letters, digits and hyphens, single blanks; accents dropped, other signs blanks. Null stays."""
    low = F.lower(text)
    for c, p in _MANY.items():
        low = F.replace(low, F.lit(c), F.lit(p))
    low = F.translate(low, "".join(_ONE), "".join(_ONE.values()))
    low = F.regexp_replace(low, _COMBINING, "")
    return F.trim(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9\\s-]", " "), "\\s+", " "))


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def _among(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def tokens(text: Column) -> Column:
    """The words between blanks; an empty text has none."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def alias(token: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(W.TOKEN_ALIASES), token), token)


def canonicalize(text: Column) -> Column:
    """Normalised text with known foods by one name: phrases first, then single words."""
    out = normalize(text)
    for source, target in W.PHRASE_ALIASES:
        out = F.regexp_replace(out, rf"\b{source}\b", target)
    return F.array_join(F.transform(tokens(out), alias), " ")


def singular(token: Column) -> Column:
    """The singular by ending; a known word goes by its table."""
    n = F.length(token)
    return (
        F.when(F.try_element_at(_lookup(W.TOKEN_ALIASES), token).isNotNull(), alias(token))
        .when((n > 4) & token.endswith("ies"), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & token.endswith("oes"), F.substring(token, F.lit(1), n - 2))
        .when((n > 3) & token.endswith("s") & ~token.endswith("ss"), F.substring(token, F.lit(1), n - 1))
        .otherwise(token)
    )


def _food_words(line: Column) -> Column:
    """The words of a line in order, numbers taken out after folding."""
    text = F.regexp_replace(normalize(line), r"\b\d+\b", " ")
    for source, target in W.PHRASE_ALIASES:
        text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), rf"\b{source}\b", target)
    return F.transform(F.filter(F.split(text, r"\s+"), lambda t: t != ""), alias)


def terms(line: Column, ignored: list[str] | None = None) -> Column:
    """Distinct single words and pairs of neighbours of an ingredient line, singular; units and preparations left out.

    A pair counts only if no word, not even one left out, stands between the two.
    """
    stop = _among(ignored or [*W.UNITS, *W.PREPARATION])
    raw = _food_words(line)
    keep = lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)
    marked = F.transform(raw, lambda t: F.when(keep(t), singular(t)))
    single = F.filter(marked, lambda t: t.isNotNull())
    pairs = F.zip_with(marked, F.slice(marked, F.lit(2), F.greatest(F.size(marked), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.array_union(single, F.filter(pairs, lambda t: t.isNotNull())))


def recipe_terms(lines: Column) -> Column:
    """All distinct terms of the lines, sorted; null lines have none."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(lines, lambda x: x.isNotNull()), lambda x: terms(x)))))


def distinctive(term_array: Column) -> Column:
    """Single words of more than two letters that are neither noise nor staples."""
    noise = _among([*W.DISTINCTIVE_NOISE, *W.PANTRY])
    return F.filter(term_array, lambda t: (F.length(t) > 2) & ~t.contains(" ") & ~F.array_contains(noise, t))


def contains_phrase(text: Column, phrase: str) -> Column:
    """Whether a normalised text holds a phrase, no letter or digit beside it."""
    return text.rlike(rf"(?<!\w){phrase}(?!\w)")


def first_hit(text: Column, table: list[tuple[str, list[str] | str]], default: str | None) -> Column:
    """The first name in the table one of whose parts the text contains."""
    out = None
    for name, parts in table:
        hit = reduce(lambda a, b: a | b, (text.contains(p) for p in parts))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(default))


def category(name: Column) -> Column:
    """The dish category of a title, by parts of words; ``other`` without any."""
    return first_hit(normalize(name), W.CATEGORIES, "other")


def document_text(name: Column, lines: Column) -> Column:
    """Name and lines, normalised, at most 1,600 characters: the text that the lexical index is defined on."""
    return F.substring(normalize(F.concat_ws(" ", name, F.array_join(F.filter(lines, lambda x: x.isNotNull()), " "))), 1, 1600)


def search_text(name: Column, lines: Column, description: Column) -> Column:
    return F.concat_ws("\n", name, F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"), description)


def minutes(duration: Column) -> Column:
    """Minutes of an ISO duration of hours and minutes; null for anything else."""
    text, shape = F.trim(duration), r"(?i)^PT(?:(\d+)H)?(?:(\d+)M)?$"
    part = lambda k: F.coalesce(F.expr("cast(null as bigint)"), F.nullif(F.regexp_extract(text, shape, k), F.lit("")).cast("bigint"))
    fits = text.rlike(r"(?i)^PT(?:\d{1,9}H)?(?:\d{1,9}M)?$") & (F.upper(text) != "PT")
    return F.when(fits, F.coalesce(part(1), F.lit(0)) * 60 + F.coalesce(part(2), F.lit(0)))


def total_minutes(prep: Column, cook: Column) -> Column:
    return minutes(prep) + minutes(cook)


@F.pandas_udf(StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or "&" not in t else html.unescape(html.unescape(t)))


def unescape(text: Column) -> Column:
    """HTML entities decoded, up to twice."""
    return _unescaped(text)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def unquote(text: Column) -> Column:
    """A description without one balanced pair of outer double quotes; blank becomes null."""
    t = blank_to_null(text)
    inner = blank_to_null(F.substring(t, F.lit(2), F.length(t) - 2))
    return F.when((F.length(t) >= 2) & ((t.startswith('"') & t.endswith('"')) | (t.startswith("“") & t.endswith("”"))), inner).otherwise(t)


def safe_url(url: Column) -> Column:
    """The URL if it is http or https and has a host."""
    t = blank_to_null(url)
    return F.when(t.rlike("^(?i:https?)://[^/?#]+"), t)


def canonical_url(url: Column) -> Column:
    """Old addresses of three publishers in their present form; others, odd ports and credentials as they are.

    The query stays, the fragment goes with a rewritten address.
    """
    authority = F.regexp_extract(url, "^[^:]+://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, ":.*$", ""))
    port = F.regexp_extract(authority, ":(.*)$", 1)
    path = F.regexp_extract(url, "^[^:]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^#?]*(\?[^#]*)", 1)
    query = F.when(query == "?", "").otherwise(query)
    plain = ~authority.contains("@") & port.isin("", "80", "443")
    slug = lambda shape: F.lower(F.regexp_extract(path, shape, 1))
    views, legacy, current = r"(?i)^/recipes/food/views/([^/]+)/?$", r"(?i)^/recipes/(?:quick-recipes/)?\d{4}/\d{2}/([^/]+)/?$", r"(?i)^/recipe/([^/]+)/?$"
    on = lambda name: plain & host.isin(name, f"www.{name}")
    return (
        F.when(on("epicurious.com") & path.rlike(views), F.concat(F.lit("https://www.epicurious.com/recipes/food/views/"), slug(views), query))
        .when(on("bonappetit.com") & path.rlike(legacy), F.concat(F.lit("https://www.bonappetit.com/recipe/"), slug(legacy), query))
        .when(on("bonappetit.com") & path.rlike(current), F.concat(F.lit("https://www.bonappetit.com/recipe/"), slug(current), query))
        .when(on("allrecipes.com"), F.concat(F.lit("https://www.allrecipes.com"), path, query))
        .otherwise(url)
    )


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, "^[^:]+://([^/?#]*)", 1), "^www\\.", "")


def cleaned_lines(lines: list[str]) -> list[str]:
    """Lines with single blanks, blank ones dropped; then a first line that repeats all others, then repeats of the line
    before. Lines are compared without blanks and case."""
    bare = lambda t: "".join(t.split()).casefold()
    flat = [" ".join(x.split()) for x in lines]
    flat = [x for x in flat if x]
    if len(flat) > 1 and bare(flat[0]) == bare(" ".join(flat[1:])):
        flat = flat[1:]
    return [x for k, x in enumerate(flat) if not k or bare(x) != bare(flat[k - 1])]


@F.pandas_udf(StringType())
def _cleaned(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "\n".join(cleaned_lines(re.split(r"\r\n|\n|\r", t))))


def clean_method(text: Column) -> Column:
    """Instructions by :func:`cleaned_lines`. One Arrow pass: as array functions every look at a line makes all lines anew."""
    return _cleaned(text)
