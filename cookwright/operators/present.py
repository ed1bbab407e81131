"""Presentation of recipes: labels, summaries, facts, steps and marked amounts."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import groupby, takewhile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from cookwright.functions import text as T
from cookwright.functions import words as W
from cookwright.functions.query_text import canonicalize, normalize_text

_AND_OR = ("and", "or")
_SKIPPED = frozenset([*W.LABEL_SKIP, *W.LABEL_UNITS])
_AMOUNT = re.compile(r"^(?:\d+|one|two|three|four|five|six)\s+")


def _bare(words: list[str]) -> list[str]:
    """Words without an ``and`` or ``or`` at either end."""
    at = [k for k, w in enumerate(words) if w not in _AND_OR]
    return words[at[0] : at[-1] + 1] if at else []


def _told(line: str) -> list[str]:
    """The words of a line that tell what it is, up to the first clause: no amounts, units or preparations, no word
    twice in a row."""
    plain = _AMOUNT.sub("", canonicalize(re.sub(r"\([^)]*\)", " ", line))).split()
    own = [w for w in takewhile(lambda w: w not in W.CLAUSE_WORDS, plain) if w not in _SKIPPED and not w[0].isdigit()]
    return [w for w, _ in groupby(own)]


def label_of(line: str) -> str | None:
    """Up to five words that name a line's ingredient; None for headings, alternatives and staples."""
    if line.rstrip().endswith(":") or normalize_text(line).split(" ", 1)[0] in ("if", "or", "store-bought"):
        return None
    label = " ".join(_bare(_bare(_told(line))[:5])).strip(" -")
    norm = normalize_text(label)
    content = {w for w in norm.split() if w not in _AND_OR}
    staple = norm in W.PANTRY_LABELS or (content and content.issubset(W.PANTRY_WORDS))
    return label if label and not staple else None


def features_of(name: str | None, lines: list[str], limit: int = 3) -> list[str]:
    """The labels that tell most about a dish: early lines and words of the title first, trimmings last."""
    words = lambda t: set(t.replace("-", " ").split())
    title, seen, found = words(normalize_text(name or "")), set(), []
    for k, line in enumerate(lines):
        label = label_of(line)
        norm = normalize_text(label or "")
        if norm and norm not in seen:
            seen.add(norm)
            own = words(norm) - set(_AND_OR)
            found.append((min(k, 20) * 0.025 - 2.0 * len(title & own) + 0.6 * len(own & set(W.FEATURE_PENALTIES)), k, label))
    return [x for _, _, x in sorted(found)[:limit]]


def joined(parts: list[str]) -> str:
    """Parts as a list in prose: with ``and``, and a comma before it from three on."""
    return " and ".join(parts) if len(parts) < 3 else f"{', '.join(parts[:-1])}, and {parts[-1]}"


def summary_of(name: str | None, lines: list[str] | None, description: str | None) -> str:
    """The description, or a sentence made of the dish's style, kind and features."""
    if description:
        return description
    title = normalize_text(name or "")
    style = next((b for a, b in W.STYLES if a in title), None)
    kind = next((b for a, b in W.DISH_KINDS if a in title), "recipe")
    noun = f"{style} {kind}" if style and not kind.startswith(style) else kind
    some = features_of(name, [x for x in (lines if lines is not None else ()) if x is not None])
    return f"A {noun} featuring {joined(some)}." if some else f"A {noun} from the recipe collection."


@F.pandas_udf(StringType())
def _summaries(name: pd.Series, lines: pd.Series, description: pd.Series) -> pd.Series:
    return pd.Series([summary_of(*x) for x in zip(name, lines, description)], index=name.index, dtype=object)


def summary(name: Column, lines: Column, description: Column) -> Column:
    """:func:`summary_of` as a column. One Arrow pass: as array functions 300 rows took 220 s, so 6 s."""
    return _summaries(name, lines, description)


def format_minutes(n: Column) -> Column:
    """``1 hr 20 min``; null for null and negative numbers."""
    hours, rest = F.floor(n / 60), n % 60
    return F.when(n >= 0, F.concat_ws(" ", F.when(hours > 0, F.concat(hours.cast("string"), F.lit(" hr"))), F.when((rest > 0) | (hours == 0), F.concat(rest.cast("string"), F.lit(" min")))))


def format_duration(text: Column) -> Column:
    """An ISO duration in words with the numbers as written; other text as it is; blank is null."""
    shape = r"(?i)^PT(?:(\d+)H)?(?:(\d+)M)?$"
    part = lambda k, unit: F.when(F.regexp_extract(text, shape, k) != "", F.concat(F.regexp_extract(text, shape, k), F.lit(unit)))
    return F.when(text.rlike(shape) & (F.upper(text) != "PT"), F.concat_ws(" ", part(1, " hr"), part(2, " min"))).otherwise(F.nullif(text, F.lit("")))


def time_fact(prep: Column, cook: Column) -> Column:
    """The time to show: the total, else cooking, else preparation; null without any."""
    fact = lambda v, what: F.when(v.isNotNull(), F.struct(F.lit("time").alias("kind"), v.alias("value"), F.concat(v, F.lit(what)).alias("label")))
    return F.coalesce(fact(format_minutes(T.total_minutes(prep, cook)), " total time"), fact(format_duration(cook), " cooking time"), fact(format_duration(prep), " preparation time"))


def compact_yield(text: Column, most: int = 36) -> Column:
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when((t != "") & (F.length(t) <= most), t)


def fact_items(prep: Column, cook: Column, recipe_yield: Column, lines: Column) -> Column:
    """Time, yield and number of ingredients as ``kind, value, label``; what is missing is left out."""
    y, n = compact_yield(recipe_yield), F.coalesce(F.size(lines), F.lit(0))
    n = F.greatest(n, F.lit(0))
    count = F.concat(n.cast("string"), F.when(n == 1, " ingredient").otherwise(" ingredients"))
    makes = F.when(y.rlike(r"(?i)^makes?\b"), y).otherwise(F.concat(F.lit("Makes "), y))
    items = F.array(time_fact(prep, cook), F.when(y.isNotNull(), F.struct(F.lit("yield").alias("kind"), y.alias("value"), makes.alias("label"))), F.struct(F.lit("ingredients").alias("kind"), count.alias("value"), count.alias("label")))
    return F.filter(items, lambda x: x.isNotNull())


def facts(prep: Column, cook: Column, recipe_yield: Column, lines: Column) -> Column:
    return F.array_join(F.transform(fact_items(prep, cook, recipe_yield, lines), lambda x: x.label), " · ")


def source_label(source: Column) -> Column:
    """A publisher's name as it is shown; unknown ones with blanks for ``_`` and ``-``."""
    t = F.regexp_replace(source, r"(?U)^\s+|\s+$", "")
    table = F.create_map(*(F.lit(x) for kv in W.SOURCE_LABELS.items() for x in kv))
    return F.when(t != "", F.coalesce(F.try_element_at(table, F.lower(t)), F.regexp_replace(F.regexp_replace(t, "[_-]+", " "), r"(?U)\s+", " ")))


def source_icon(source: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in W.SOURCE_ICONS.items() for x in kv))
    return F.try_element_at(table, F.lower(F.regexp_replace(F.coalesce(source, F.lit("")), r"(?U)^\s+|\s+$", "")))


_NUMBER_OF_STEP = re.compile(r"^(?:step\s*)?\d+\s*[.):]\s*", re.IGNORECASE)


def steps_of(text: str | None) -> list[str]:
    """The steps without their numbers: repeats dropped, so is a step that holds a later one of 24 characters or more."""
    some = [x for s in (text or "").split("\n") if (x := _NUMBER_OF_STEP.sub("", s.strip()).strip())]
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    for k, s in enumerate(some):
        first.setdefault(s, k)
        last[s] = k
    held = [(k, s) for s, k in last.items() if len(s) >= 24]
    return [s for s, k in first.items() if not any(at > k and len(s) > len(z) and z in s for at, z in held)]


@F.pandas_udf(ArrayType(StringType()))
def _steps(s: pd.Series) -> pd.Series:
    return s.map(steps_of)


def steps(instructions: Column) -> Column:
    """:func:`steps_of` as a column, in one Arrow pass; null gives no step."""
    return _steps(instructions)


def ingredient_items(text: Column) -> Column:
    """The entries of an ingredient box: split at commas, semicolons and line ends, blanks dropped."""
    return F.filter(F.transform(F.split(text, "[,;\n]+"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


@lru_cache(maxsize=1)
def _patterns() -> tuple:
    # What is marked as a temperature, a time, an amount.
    fraction = r"(?:\d+\s+\d+/\d+|\d+\s*[¼½¾⅓⅔⅛⅜⅝⅞]|\d+/\d+|[¼½¾⅓⅔⅛⅜⅝⅞])"
    number = rf"(?:{fraction}|\d+(?:\.\d+)?|\.\d+)"
    quantity = rf"(?:{number}|a|an)"
    span = rf"{quantity}(?:\s*(?:-|–|to)\s*{quantity})?"
    time = r"(?:seconds?|secs?\.?|minutes?|mins?\.?|hours?|hrs?\.?|days?)"
    unit = r"(?:teaspoons?|tsp\.?|tablespoons?|tbsp\.?|cups?|fluid\s+ounces?|fl\.?\s*oz\.?|ounces?|oz\.?|pounds?|lbs?\.?|grams?|kilograms?|millilit(?:er|re)s?|lit(?:er|re)s?|gallons?|quarts?|pints?|kg|mg|ml|g|l|pinches?|dashes?|drops?|cans?|packages?|pkgs?\.?|sticks?|cloves?|slices?|pieces?|heads?|bunches?|sprigs?|stalks?|inches?|cm)"
    degrees = r"(?:°\s*[cf]|degrees?(?:\s+(?:celsius|fahrenheit)|\s*[cf])?)"
    marks = (("temperature", 3, rf"{number}(?:\s*(?:-|–|to)\s*{number})?\s*{degrees}"), ("time", 2, rf"{span}(?:\s+|-\s*){time}"), ("amount", 1, rf"{span}(?:\s+|-\s*){unit}"))
    return tuple((k, p, re.compile(x, re.I)) for k, p, x in marks), re.compile(rf"\s*({quantity})", re.I)


def annotate(text: str | None, leading: bool) -> list[tuple[int, int, str]]:
    """Start, end and kind of the amounts, times and temperatures in a text; no two overlap, the longest first."""
    if not text:
        return []
    marks, lead = _patterns()
    word = lambda c: c.isalnum() or c == "_"
    found = [(m.start(), -m.end(), -p, k) for k, p, x in marks for m in x.finditer(text) if not (m.start() and word(text[m.start() - 1])) and not (m.end() < len(text) and word(text[m.end()]))]
    if leading and (m := lead.match(text)):
        found.append((m.start(1), -m.end(1), 0, "amount"))
    out, at = [], 0
    for start, end, _p, kind in sorted(found):
        if start >= at:
            out.append((start, -end, kind))
            at = -end
    return out


def _marker(leading: bool):
    @F.pandas_udf("array<struct<start:int,end:int,kind:string>>")
    def mark(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"start": a, "end": b, "kind": k} for a, b, k in annotate(t, leading)])

    return mark


def annotations(text: Column, leading: bool) -> Column:
    """The marked spans of a text (offsets in characters); ``leading`` marks a bare number in front too."""
    return _marker(leading)(text)


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def format_html(text: Column, leading: bool) -> Column:
    """The text escaped, its marked spans wrapped in spans of class ``recipe-<kind>``."""
    marks = annotations(text, leading)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    piece = lambda a, b: escape_html(F.substring(text, a + 1, b - a))
    step = lambda acc, m: F.struct(m.end.alias("at"), F.concat(acc.out, piece(acc.at, m.start), F.lit('<span class="recipe-'), m.kind, F.lit('">'), piece(m.start, m.end), F.lit("</span>")).alias("out"))
    return F.aggregate(marks, start, step, lambda acc: F.concat(acc.out, piece(acc.at, F.length(text))))
