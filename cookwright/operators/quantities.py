"""Amounts stated in text, in common units.

A multi-pattern automaton finds unit names beside numbers; the longest name wins, and the field decides
whether a bare number is a count. The amounts found are joined with the broadcast table of factors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cookwright.functions.encoding import LOST, SINGLE, garble, repair
from cookwright.plans.frames import spread

# Other names of the units, by the name that the table of factors has.
ALIASES = {
    "g": "g gr gm gram grams gramm gramme grammes gramo gramos gms grs",
    "kg": "kg kgs kilo kilos kilogram kilograms kilogramm kilogramo kilogramos kilogramme",
    "hg": "hg hekto hektogram hectogram",
    "oz": "oz ozs ounce ounces onza onzas unze unzen uns",
    "lb": "lb lbs pound pounds libra libras",
    "pfund": "pfund pfd",
    "ml": "ml mls milliliter milliliters millilitre millilitres mililitro mililitros millilitern",
    "cl": "cl centiliter centiliters centilitre centilitres centilitro centilitros zentiliter",
    "dl": "dl deciliter deciliters decilitre decilitres decilitro decilitros deziliter",
    "l": "l lt ltr liter liters litre litres litro litros litern",
    "tsp": "tsp tsps teaspoon teaspoons tsk tesked teskedar cucharadita cucharaditas cdta cdtas cdita tl teelöffel",
    "tbsp": "tbsp tbsps tbs tablespoon tablespoons msk matsked matskedar cucharada cucharadas cda cdas el esslöffel",
    "krm": "krm kryddmått",
    "cup": "cup cups c taza tazas tasse tassen kopp koppar",
    "fl oz": "fl_oz fluid_ounce fluid_ounces fluid_oz fl_ounce fl_ounces onza_líquida onzas_líquidas floz",
    "pint": "pint pints pt pts pinta pintas",
    "quart": "quart quarts qt qts",
}
# Numbers in words. The articles only count right before a unit or a dozen.
WORDS = {
    1: "one ett una eins",
    2: "two två dos zwei", 3: "three tre tres drei", 4: "four fyra cuatro vier", 5: "five fem cinco fünf", 6: "six sex seis sechs",
    7: "seven sju siete sieben", 8: "eight åtta ocho acht", 9: "nine nio nueve neun", 10: "ten tio diez zehn", 11: "eleven elva once elf",
    12: "twelve tolv doce zwölf", 13: "thirteen tretton trece dreizehn", 14: "fourteen fjorton catorce vierzehn", 15: "fifteen femton quince fünfzehn",
    16: "sixteen sexton dieciséis sechzehn", 18: "eighteen arton dieciocho achtzehn", 20: "twenty tjugo veinte zwanzig", 24: "twenty-four", 30: "thirty trettio treinta dreißig",
}
HALF = "half halv halvt media medio halb halbe halber halbes"
ARTICLES = "a an en ett un una uno ein eine einen"
# Words between a number and its unit that change nothing.
FILLERS = "heaped heaping level scant generous rounded good big small large full packed about approx struken strukna rågad rågade toppad knapp knappa drygt rasa rasas colmada colmadas escasa escasas generosa generosas gestrichen gestrichene gestrichener gehäuft gehäufte gehäufter leicht knapper knappe guter gute of"
DOZEN = "dozen dozens doz dussin docena docenas dutzend"
PACKS = "can cans tin tins jar jars pack packs packet packets package packages pkg box boxes bag bags bottle bottles carton cartons tub tubs burk burkar paket förpackning förpackningar flaska flaskor påse påsar lata latas bote botes paquete paquetes frasco frascos tarro tarros botella botellas dose dosen glas gläser packung packungen päckchen flasche flaschen beutel becher"
# What follows a number that is no count.
NO_COUNT = "cm mm inch inches in min mins minute minutes minuten minuter minutos h hour hours stunden timmar horas day days % ° degrees grader grados grad kcal cal"
_FRACTIONS = {"½": "1/2", "¼": "1/4", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6"}

_WORD_VALUE = {w: n for n, ws in WORDS.items() for w in ws.split()}
_alt = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))
_NUM = rf"(?:\d+(?:\s+|\s?-\s?)\d+/\d+|\d+/\d+|\d+(?:[.,]\d+)?|\b(?:{_alt([*_WORD_VALUE, *HALF.split()])})\b)"
_RANGE = rf"(?P<n>{_NUM})(?:\s*(?:-|\bto\b|\btill\b|\ba\b|\bbis\b|\bhasta\b|\bor\b|\beller\b|\boder\b|\bo\b)\s*(?P<hi>{_NUM}))?"
#: A number that ends right where a unit begins.
_BEFORE = re.compile(rf"(?:(?<![\w/.,])|(?<=x)){_RANGE}(?:\s+(?:{_alt(ARTICLES.split())})\b)?(?:\s*-)?(?:\s+(?:{_alt(FILLERS.split())})\b)*\s*$")
_ARTICLE = re.compile(rf"(?<!\w)(?:{_alt(ARTICLES.split())})(?:\s+(?P<half>{_alt(HALF.split())}))?(?:\s+(?:{_alt(FILLERS.split())})\b)*\s*$")
_PACK = _alt(PACKS.split())
_TIMES = re.compile(rf"(?<![\w/.,])(?P<m>{_NUM})\s*(?:x\s*|(?P<paren>\(\s*)|(?P<pack>(?:\w+\s+)?\b(?:{_PACK})\b\.?\s*\(\s*(?:(?P<each>à|je|each)\s+)?)|(?P<bare>\s))$")
_AND_ON = re.compile(rf"^\.?\s*(?:\+|&|,|plus|and|och|und|y|más|mas)?\s*(?P<n>{_NUM})(?:\s*-)?(?:\s+(?:{_alt(FILLERS.split())})\b)*\s*$")
_PACK_NEXT = re.compile(rf"^[\s.\-)]*(?:\w+\s+)?(?:{_PACK})\b")
_DOZEN = re.compile(rf"(?:(?<![\w/.,])(?P<n>{_NUM})|(?:(?<!\w)(?:{_alt(ARTICLES.split())})))?(?:\s*(?:-|to|till|a|bis)\s*{_NUM})?(?:\s+(?:{_alt(ARTICLES.split())}))?\s*\b(?:{_alt(DOZEN.split())})\b")
_COUNT = re.compile(rf"(?<![\w/.,]){_RANGE}(?!\w|[.,/]\d)(?!\s*(?:{_alt(NO_COUNT.split())})(?!\w))")
#: Words that may stand between a number and its unit, or between a number of packs and what one holds.
_BETWEEN = frozenset(" ".join([*WORDS.values(), HALF, ARTICLES, FILLERS, PACKS, "x to till bis hasta or eller oder o à je each"]).split())
_SPACES = re.compile(r"\s+")
_MIXED = re.compile(r"(\d+)(?:\s+|\s?-\s?)(\d+)/(\d+)$")


def _value(text: str) -> tuple[int, int] | None:
    """Numerator and denominator of a number as written."""
    text = text.strip()
    if m := _MIXED.match(text):
        whole, a, b = map(int, m.groups())
        return (whole * b + a, b) if b else None
    if "/" in text:
        a, b = map(int, text.split("/"))
        return (a, b) if b else None
    if text[:1].isdigit():
        whole, _, part = text.replace(",", ".").partition(".")
        return int(whole + part), 10 ** len(part)
    return (_WORD_VALUE[text], 1) if text in _WORD_VALUE else (1, 2)


def _low(m: re.Match) -> tuple[int, int] | None:
    """The number of a match, or the lower end of its range. ``4-1/2`` is a mixed number, not a range."""
    return _value(m["n"])


def _spellings(alias: str) -> set[str]:
    """The name as it stands in sound text, without its accents lost, and in text damaged one byte at a time."""
    alias = alias.replace("_", " ")
    out = {alias}
    if not alias.isascii():
        out |= {g.lower() for c in SINGLE if (g := garble(alias, c))}
        out.add(re.sub(r"[^\x00-\x7f]", LOST, alias))
    return out


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for unit, names in ALIASES.items():
        for name in names.split():
            for s in _spellings(name):
                auto.add_word(s, (len(s), unit))
                if " " in s:
                    auto.add_word(s.replace(" ", ". "), (len(s) + 1, unit))
    auto.make_automaton()
    return auto


#: Signs that code pages of one byte make of a fraction, a times sign or a dash beside a digit.
_DAMAGED = {g: c for chain in reversed(SINGLE[:2]) for c in "½¼¾×–" if (g := garble(c, chain)) and g not in _FRACTIONS and len(g) == 1}
_BESIDE_DIGIT = re.compile(rf"(?<=\d)(\s?)([{re.escape(''.join(_DAMAGED))}])(?=\s|[a-z\d])|^()([{re.escape(''.join(_DAMAGED))}])(?=\s)")
_ANY_DAMAGED = re.compile(f"[{re.escape(''.join(_DAMAGED))}]")
_SAME = {"×": "x", "–": "-", "—": "-", "−": "-", "⁄": "/", "\u00a0": " ", "\u2009": " ", "\u202f": " "}
_SIGNS = re.compile(f"[{''.join([*_FRACTIONS, *_SAME])}]")


def _plain(line: str) -> str:
    if not line.isascii():
        line = repair(line)
        if _ANY_DAMAGED.search(line):
            line = _BESIDE_DIGIT.sub(lambda m: (m[1] or "") + _DAMAGED[m[2] or m[4]], line)
        line = _SIGNS.sub(lambda m: _SAME.get(m[0]) or " " + _FRACTIONS[m[0]], line)
    if "  " in line or "\t" in line:
        line = _SPACES.sub(" ", line)
    return line.strip().lower()


def _units(line: str) -> list[tuple[int, int, str]]:
    """Unit names in the line, as start, end and unit; of overlapping names the longest."""
    found: list[tuple[int, int, str]] = []
    for last, (size, unit) in _automaton().iter(f" {line} "):
        start = last - size
        if start < 0 or (start and line[start - 1].isalpha()) or (end := line[last : last + 1]).isalnum() or end == LOST:
            continue
        while found and found[-1][0] >= start:
            found.pop()
        if not found or found[-1][1] <= start:
            found.append((start, last, unit))
    return found


def _reach(text: str, end: int, strange: int) -> int:
    """How far before ``end`` a number with what belongs to it can begin: back over words that may stand between a
    number and its unit, and over as many others as ``strange``. Whatever the length of the line."""
    at = end
    while at > 0:
        begin = text.rfind(" ", 0, at - 1) + 1 if at > 1 else 0
        word = text[begin:at].strip(" ().,-&+")
        if word.isalpha() and word not in _BETWEEN:
            strange -= 1
            if strange < 0:
                break
        at = begin
    return at


def parse_amounts(line: str | None, is_yield: bool = False) -> list[tuple[int, int, str]]:
    """The first amount that the line states: numerator, denominator and unit of each of its parts.

    There is one part but for a compound amount (``1 lb 4 oz``). A range gives its lower end, several packs
    their total. ``is_yield``: a bare number is a count, and a dozen is twelve. No amount gives no part.
    """
    if not line:
        return []
    text = _plain(line)
    units = _units(text)
    first_at, parts = len(text) + 1, []
    for k, (start, end, unit) in enumerate(units):
        since = _reach(text, start, 0)
        m = _BEFORE.search(text, since, start)
        if m:
            value, at = _low(m), m.start()
        elif (m := _ARTICLE.search(text, since, start)) and (end - start > 1 or m[0][0] in "eu"):
            value, at = (1, 2) if m["half"] else (1, 1), m.start()
        else:
            continue
        if not value or not value[0]:
            continue
        num, den = value
        if at and (t := _TIMES.search(text, _reach(text, at, 1), at)):
            times = _value(t["m"])
            if times and (not t["bare"] or _PACK_NEXT.match(text[end:])):
                num, den, at = num * times[0], den * times[1], t.start()
        first_at, parts = at, [(num, den, unit)]
        for start, after, unit in units[k + 1 :]:
            if not ((m := _AND_ON.match(text[end:start])) and (more := _value(m["n"]))):
                break
            parts.append((*more, unit))
            end = after
        break
    if is_yield:
        if m := _DOZEN.search(text):
            n, d = _value(m["n"]) if m["n"] else (1, 1)
            return [(12 * n, d, "count")] if m.start() < first_at else parts
        if (m := _COUNT.search(text)) and m.start() < first_at and (v := _low(m)) and v[0]:
            return [(*v, "count")]
    return parts


_PART = pa.struct([("unit", pa.string()), ("num", pa.int64()), ("den", pa.int64())])
_OUT = pa.schema([("row_ix", pa.int64()), ("field", pa.string()), ("line_no", pa.int64()), ("parts", pa.list_(_PART))])
_DDL = "row_ix long, field string, line_no long, parts array<struct<unit: string, num: long, den: long>>"
#: Numbers from here on, in lowest terms, have no thousandths within a bigint.
_BEYOND = 10**18


def _row(row_ix: int, field: str, no: int, parts: list[tuple[int, int, str]]) -> tuple | None:
    lowest = [{"unit": u, "num": n // (g := gcd(n, d)), "den": d // g} for n, d, u in parts]
    return (row_ix, field, no, lowest) if lowest and all(p["num"] < _BEYOND and p["den"] < _BEYOND for p in lowest) else None


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple | None] = []
        for row_ix, lines, amount in zip(*(c.to_pylist() for c in batch.columns)):
            rows += [_row(row_ix, "ingredients", no, parse_amounts(line)) for no, line in enumerate(lines or ()) if line]
            if amount:
                rows.append(_row(row_ix, "recipe_yield", 0, parse_amounts(amount, True)))
        if kept := [r for r in rows if r]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*kept), _OUT)], schema=_OUT)


def quantities(recipes: DataFrame, factors: DataFrame) -> DataFrame:
    """``row_ix, field, line_no, unit, amount_milli``: each stated amount in g, ml or count, times 1000.

    Half a thousandth is rounded up. ``recipes`` needs ``row_ix, ingredients, recipe_yield``, other columns are
    ignored; ``factors`` needs ``unit, base_unit, factor`` and names each unit once (a repeated name counts with
    its largest factor). Null and empty lines, lines without an amount, and amounts of zero give no row; an
    amount whose unit the table does not have gives none either. All parts of a compound amount count, but for those
    whose unit the table has not or has under another base. A repeated ``row_ix`` gives its rows each time.
    Lines are read whole. An amount whose thousandths a bigint can't hold gives no row. No shuffle: one pass over the
    input, then a broadcast join with the factors of the known units in one row.
    """
    found = spread(recipes.select("row_ix", "ingredients", "recipe_yield")).mapInArrow(_parse_batches, _DDL)
    known = factors.where(F.col("unit").isin(list(ALIASES)) & F.col("base_unit").isNotNull() & (F.col("factor") > 0)).groupBy("unit").agg(F.max(F.struct("factor", "base_unit")).alias("f"))
    known = known.select("unit", F.struct(F.col("f.base_unit").alias("base"), (F.col("f.factor") * 1_000_000).cast("decimal(13,0)").alias("millionths")).alias("f"))
    known = known.union(factors.sparkSession.sql("select 'count', struct('count' as base, cast(1000000 as decimal(13,0)) as millionths)"))
    per = known.agg(F.map_from_entries(F.collect_list(F.struct("unit", "f"))).alias("factors"))  # a row for each unit of ALIASES at most
    f = lambda unit: F.try_element_at("factors", unit)
    milli = lambda p: (p.num.cast("decimal(18,0)") * f(p.unit).millionths / (p.den.cast("decimal(18,0)") * F.lit(1000).cast("decimal(4,0)"))).cast("decimal(38,6)")
    base = f(F.get("parts", F.lit(0)).unit).base
    added = F.aggregate("parts", F.lit(0).cast("decimal(38,6)"), lambda a, p: (a + F.when(f(p.unit).base == F.col("unit"), milli(p)).otherwise(F.lit(0).cast("decimal(38,6)"))).cast("decimal(38,6)"))
    total = F.when(F.size("parts") == 1, milli(F.get("parts", F.lit(0)))).otherwise(added)
    out = found.join(F.broadcast(per)).withColumn("unit", base).where("unit is not null")
    return out.select("row_ix", "field", "line_no", "unit", F.round(total).try_cast("long").alias("amount_milli")).where("amount_milli is not null")
