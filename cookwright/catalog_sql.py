"""SQL with the same results as the core's queries, put together from the same word tables."""

from __future__ import annotations

from cookwright.functions import words as W
from cookwright.functions.query_text import Interpretation, from_ingredients, interpret, normalize_text, query_terms

#: The wanted ingredients of ``ingredient_topk`` and the request of ``lexical_topk``.
ASKED = ["coconut milk", "red lentil", "onion"]
TEXT = "creamy soup with red lentils and coconut milk"
#: The batch of ``hybrid_search``: number, request, mode, results. Every strategy and mode is among them.
BATCH: list[tuple[int, Interpretation, str, int]] = [
    (1, interpret(TEXT), "hybrid", 10), (2, from_ingredients(["chicken", "garlic cloves", "lemon"]), "hybrid", 10), (3, interpret("pasta with tomato without garlic, onion"), "hybrid", 10), (4, interpret("not spicy chicken curry"), "lexical", 10),
    (5, interpret("salmon pie"), "semantic", 10), (6, interpret("quick vegetarian dinner"), "hybrid", 10), (7, interpret("xqzw vvvkk"), "hybrid", 8), (8, interpret("surprise me"), "hybrid", 10), (9, interpret("something new with salmon but no butter"), "hybrid", 10), (10, interpret("anything"), "lexical", 50),
    (11, interpret("lax med potatis utan lök"), "hybrid", 10), (12, interpret("algo nuevo con pollo"), "semantic", 10), (13, from_ingredients(["egg", "without milk"]), "lexical", 3),
]

_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_MAP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in W.TOKEN_ALIASES.items()) + "}"


def norm(x: str) -> str:
    for a, b in (("ß", "ss"), ("½", "1 2"), ("¼", "1 4"), ("¾", "3 4"), ("⅓", "1 3"), ("⅔", "2 3"), ("⅛", "1 8"), ("™", "tm"), ("№", "no"), ("º", "o"), ("ª", "a"), ("²", "2"), ("³", "3"), ("¹", "1"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        x = f"replace({x}, '{a}', '{b}')" if a != "ß" else f"replace(lower({x}), 'ß', 'ss')"
    return f"trim(regexp_replace(regexp_replace(strip_accents({x}), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _sing(t: str) -> str:
    return (
        f"CASE WHEN len(map_extract({_MAP}, {t})) > 0 THEN map_extract({_MAP}, {t})[1] WHEN len({t}) > 4 AND {t} LIKE '%ies' THEN {t}[:-4] || 'y'"
        f" WHEN len({t}) > 4 AND {t} LIKE '%oes' THEN {t}[:-3] WHEN len({t}) > 3 AND {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN {t}[:-2] ELSE {t} END"
    )


def _words(line: str) -> str:
    t = f"regexp_replace({norm(line)}, '\\b\\d+\\b', ' ', 'g')"
    t = f"regexp_replace({t}, '\\s+', ' ', 'g')"
    for a, b in W.PHRASE_ALIASES:
        t = f"regexp_replace({t}, '\\b{a}\\b', '{b}', 'g')"
    return f"list_transform(list_filter(string_split({t}, ' '), lambda t: t <> ''), lambda t: coalesce(map_extract({_MAP}, t)[1], t))"


_STOP = _list([*W.UNITS, *W.PREPARATION])
TERMS = f"""
lines AS (SELECT row_ix, unnest(ingredients) AS l FROM sample_recipes),
raw AS (SELECT row_ix, {_words('l')} AS w FROM lines WHERE l IS NOT NULL),
marked AS (SELECT row_ix, list_transform(w, lambda t: CASE WHEN len(t) > 1 AND NOT list_contains({_STOP}, t) THEN {_sing('t')} END) AS m FROM raw),
post AS (
  SELECT DISTINCT row_ix, term FROM (
    SELECT row_ix, unnest(m) AS term FROM marked
    UNION ALL SELECT row_ix, unnest(list_transform(range(1, len(m)), lambda i: m[i] || ' ' || m[i + 1])) FROM marked
  ) WHERE term IS NOT NULL
)
"""
_NAMES = f"names AS (SELECT row_ix, {norm('name')} AS name_norm FROM sample_recipes)"
_NOISE = _list([*W.DISTINCTIVE_NOISE, *W.PANTRY])
_DISTINCT = f"""
n AS (SELECT count(*) AS n FROM sample_recipes),
own AS (SELECT row_ix, term FROM post WHERE len(term) > 2 AND NOT contains(term, ' ') AND NOT list_contains({_NOISE}, term)),
df AS (SELECT term, count(*) AS df FROM own GROUP BY term),
v AS (SELECT term, least(ln((n + 1) / (lo + 1)), ln((n + 1) / (df + 1))) AS idf FROM (SELECT *, CASE WHEN n < 50 THEN 1 ELSE 3 END AS lo FROM df, n) WHERE df >= lo AND df <= greatest(lo, floor(n * 0.15))),
six AS (SELECT row_ix, idf FROM own JOIN v USING (term) QUALIFY row_number() OVER (PARTITION BY row_ix ORDER BY idf DESC) <= 6),
sixes AS (SELECT row_ix, CASE WHEN count(*) >= 2 THEN sum(idf ORDER BY idf DESC) / 6 ELSE 0 END AS raw FROM six GROUP BY row_ix),
allraw AS (SELECT s.row_ix, CAST(coalesce(raw, 0) AS DOUBLE) AS raw FROM sample_recipes s LEFT JOIN sixes USING (row_ix)),
p AS (SELECT quantile_cont(raw, 0.2) AS lo, quantile_cont(raw, 0.98) AS hi FROM allraw WHERE raw > 0),
exact AS (SELECT row_ix, greatest(0.0, least(1.0, (raw - lo) / (hi - lo))) AS d FROM allraw, p),
dist AS (SELECT row_ix, round(d, 6) AS distinctiveness FROM exact)
"""
_GRAMS = f"""
docs AS (SELECT row_ix, {norm("concat_ws(' ', name, array_to_string(list_filter(ingredients, lambda x: x IS NOT NULL), ' '))")} AS t FROM sample_recipes),
w AS (SELECT row_ix, ' ' || unnest(list_filter(string_split(t, ' '), lambda x: x <> '')) || ' ' AS p FROM docs),
g AS (
  SELECT row_ix, substring(p, i, 3) AS gram FROM (SELECT row_ix, p, unnest(range(1, len(p) - 1)) AS i FROM w)
  UNION ALL SELECT row_ix, substring(p, i, 4) FROM (SELECT row_ix, p, unnest(range(1, len(p) - 2)) AS i FROM w WHERE len(p) >= 4)
),
tf AS (SELECT row_ix, gram, count(*) AS c FROM g GROUP BY row_ix, gram),
nn AS (SELECT count(*) AS n FROM sample_recipes),
vocab AS (SELECT gram, count(*) AS df, CAST(sum(c) AS BIGINT) AS total FROM tf GROUP BY gram HAVING count(*) >= (SELECT CASE WHEN n < 25 THEN 1 ELSE 2 END FROM nn) ORDER BY total DESC, gram LIMIT 40000),
idf AS (SELECT gram, df, total, ln((1.0::DOUBLE + n) / (df + 1)) + 1 AS idf FROM vocab, nn)
"""
_URL = "trim(url)"
_AUTH = "regexp_extract(u, '^[^:]+://([^/?#]*)', 1)"
_MIN = lambda c: f"CASE WHEN regexp_matches(trim({c}), '^(?i)PT(\\d+H)?(\\d+M)?$') AND upper(trim({c})) <> 'PT' THEN coalesce(TRY_CAST(regexp_extract(trim({c}), '^(?i)PT(?:(\\d+)H)?(?:(\\d+)M)?$', 1) AS BIGINT), 0) * 60 + coalesce(TRY_CAST(regexp_extract(trim({c}), '^(?i)PT(?:(\\d+)H)?(?:(\\d+)M)?$', 2) AS BIGINT), 0) END"
_CAT = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(t, {chr(39)}{p}{chr(39)})' for p in ps)} THEN '{c}'" for c, ps in W.CATEGORIES) + " ELSE 'other' END"
_SPICY = _list(W.SPICY)



def _str(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _request(k: int, q: Interpretation, mode: str, most: int) -> str:
    meant = mode != "lexical" and not (q.intent != "search" and not q.ingredients and not q.preferences)
    if mode != "hybrid":
        w = (0.0, 1.0, 0.0) if mode == "lexical" or not meant else (1.0, 0.0, 0.0)
    else:
        s, x, i = (0.30, 0.15, 0.55) if q.kind == "ingredients" else (0.55, 0.25, 0.20)
        w = (s, x, i) if meant else (0.0, x / (x + i), i / (x + i))
    foreign = any(c.isalpha() and not c.isascii() for c in q.original)
    return f"({k}, {_str(mode)}, {_str(q.intent)}, {most}, {bool(q.preferences)}, {0.45 if foreign else 0.6}, {'spicy' in q.excluded_preferences}, {meant}, {w[0]!r}::DOUBLE, {w[1]!r}::DOUBLE, {w[2]!r}::DOUBLE, {len(set(q.rank_terms))}, {_str(normalize_text(q.original))})"


def _pairs(batch: list, of) -> str:
    rows = [f"({k}, {_str(t)})" for k, q, _, _ in batch for t in of(q)]
    return ", ".join(rows or ["(NULL, NULL)"])


def hybrid(batch: list[tuple[int, Interpretation, str, int]], vectors: list[list[float]]) -> str:
    """The scores, strategies and results of a batch, as CTEs up to ``result``; ``vectors`` has the requests' vectors.

    Varied picks are a recursion over the picks so far; each step takes the best candidate after the penalties.
    """
    asked = ", ".join(f"({k}, [{', '.join(repr(float(x)) for x in v)}])" for (k, *_), v in zip(batch, vectors))
    return f"""
WITH RECURSIVE {TERMS}, {_NAMES}, {_DISTINCT}, {_GRAMS},
req(request_id, mode, intent, lim, wishes, floor, no_spicy, meant, ws, wx, wi, asked, txt) AS (VALUES {', '.join(_request(*b) for b in batch)}),
want0(request_id, term) AS (VALUES {_pairs(batch, lambda q: q.rank_terms)}),
out0(request_id, term) AS (VALUES {_pairs(batch, lambda q: query_terms(q.excluded_ingredients))}),
rv(request_id, qv) AS (VALUES {asked}),
want AS (SELECT DISTINCT request_id, term FROM want0 WHERE term IN (SELECT term FROM post)),
wn AS (SELECT request_id, count(*) AS n FROM want GROUP BY request_id),
own_n AS (SELECT row_ix, count(*) AS n FROM post GROUP BY row_ix),
have AS (SELECT request_id, row_ix, count(*) AS c FROM post JOIN want USING (term) GROUP BY request_id, row_ix),
qw AS (SELECT request_id, ' ' || unnest(list_filter(string_split(txt, ' '), lambda x: x <> '')) || ' ' AS p FROM req),
qg AS (
  SELECT request_id, substring(p, i, 3) AS gram FROM (SELECT request_id, p, unnest(range(1, len(p) - 1)) AS i FROM qw)
  UNION ALL SELECT request_id, substring(p, i, 4) FROM (SELECT request_id, p, unnest(range(1, len(p) - 2)) AS i FROM qw WHERE len(p) >= 4)
),
qx AS (SELECT request_id, gram, (1 + ln(c)) * idf AS x FROM (SELECT request_id, gram, count(*) AS c FROM qg GROUP BY request_id, gram) JOIN idf USING (gram)),
qn AS (SELECT request_id, sqrt(sum(x * x)) AS s FROM qx GROUP BY request_id),
dx AS (SELECT row_ix, gram, (1 + ln(c)) * idf AS x FROM tf JOIN idf USING (gram)),
dn AS (SELECT row_ix, sqrt(sum(x * x)) AS s FROM dx GROUP BY row_ix),
lex AS (SELECT request_id, row_ix, least(1.0, sum(dx.x * qx.x) / (any_value(dn.s) * any_value(qn.s))) AS lexical FROM dx JOIN qx USING (gram) JOIN dn USING (row_ix) JOIN qn USING (request_id) GROUP BY request_id, row_ix),
rvec AS (
  SELECT row_ix, min(CAST(vec AS DOUBLE[])) AS v FROM recipe_vectors
  WHERE vec IS NOT NULL AND len(vec) = 64 AND NOT list_contains(list_transform(vec, lambda x: CAST(x AS VARCHAR) IN ('nan', '-nan', 'inf', '-inf')), true) GROUP BY row_ix
),
sem AS (SELECT request_id, row_ix, least(1.0, greatest(0.0, list_dot_product(v, qv) / sqrt(list_dot_product(v, v)))) AS semantic FROM rvec, rv WHERE list_dot_product(v, v) > 0),
spicy AS (SELECT row_ix FROM names WHERE list_contains(string_split(name_norm, ' '), 'spicy') UNION SELECT row_ix FROM post WHERE list_contains({_SPICY}, term)),
scored AS (
  SELECT r.*, n.row_ix, n.name_norm, e.d, coalesce(wn.n, 0) AS known, coalesce(l.lexical, 0.0) AS lexical, CASE WHEN meant THEN coalesce(m.semantic, 0.0) END AS semantic,
    CASE WHEN wn.n > 0 THEN least(1.0, 0.8::DOUBLE * coalesce(h.c, 0) / wn.n + 0.2::DOUBLE * coalesce(h.c, 0) / sqrt(wn.n * greatest(1, coalesce(o.n, 0)))) ELSE 0.0 END AS ingredient
  FROM req r CROSS JOIN names n JOIN exact e USING (row_ix) LEFT JOIN wn USING (request_id) LEFT JOIN have h USING (request_id, row_ix) LEFT JOIN own_n o ON o.row_ix = n.row_ix
  LEFT JOIN lex l ON l.request_id = r.request_id AND l.row_ix = n.row_ix LEFT JOIN sem m ON m.request_id = r.request_id AND m.row_ix = n.row_ix
),
plan AS (
  SELECT request_id, CASE WHEN intent = 'adventurous' THEN 'adventurous' WHEN intent = 'browse' OR low THEN 'discovery' ELSE 'search' END AS strategy, low
  FROM (SELECT request_id, any_value(intent) AS intent, any_value(intent) = 'search' AND NOT any_value(wishes) AND (any_value(known) / greatest(1, any_value(asked)) < 0.5 OR max(ingredient) < 0.3) AND max(lexical) < 0.3 AND coalesce(max(semantic), 0) < any_value(floor) AS low FROM scored GROUP BY request_id)
),
allowed AS (
  SELECT s.*, strategy, low, wx * lexical + wi * ingredient + ws * coalesce(semantic, 0) AS base FROM scored s JOIN plan USING (request_id)
  WHERE NOT (no_spicy AND row_ix IN (SELECT row_ix FROM spicy)) AND (request_id, row_ix) NOT IN (SELECT (request_id, row_ix) FROM post JOIN out0 USING (term))
),
ranked AS (
  SELECT *, CASE WHEN strategy = 'adventurous' AND (known > 0 OR wishes) THEN 0.82::DOUBLE * base + 0.18::DOUBLE * d WHEN strategy = 'search' THEN base ELSE d END AS final FROM allowed
),
plain AS (
  SELECT request_id, row_ix, CAST(row_number() OVER (PARTITION BY request_id ORDER BY final DESC, row_ix) AS INT) AS rank, lim
  FROM (SELECT * FROM ranked WHERE strategy = 'search' QUALIFY row_number() OVER (PARTITION BY request_id, name_norm ORDER BY final DESC, row_ix) = 1) QUALIFY rank <= lim
),
lists AS (SELECT row_ix, list(term) AS terms FROM post GROUP BY row_ix),
near AS (
  SELECT request_id, row_ix, name_norm, final, lim, coalesce(terms, []) AS terms, {_CAT.replace('contains(t,', 'contains(name_norm,')} AS cat
  FROM (SELECT * FROM ranked WHERE strategy <> 'search' QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY final DESC, row_ix) <= 250) LEFT JOIN lists USING (row_ix)
  WHERE len(list_intersect(string_split(name_norm, ' '), {_list(W.NON_DISH)})) = 0
),
picks AS (
  SELECT DISTINCT request_id, 0 AS step, lim, CAST(NULL AS BIGINT) AS row_ix, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS cats, CAST([] AS VARCHAR[][]) AS had FROM near
  UNION ALL
  SELECT request_id, step + 1, lim, row_ix, list_append(names, name_norm), list_append(cats, cat), list_append(had, terms) FROM (
    SELECT p.request_id, p.step, p.lim, c.row_ix, p.names, p.cats, p.had, c.name_norm, c.cat, c.terms, c.final,
      c.final - 0.18::DOUBLE * coalesce(list_max(list_transform(p.had, lambda t: CASE WHEN len(t) + len(c.terms) > 0 THEN len(list_intersect(t, c.terms)) / (len(t) + len(c.terms) - len(list_intersect(t, c.terms))) ELSE 0.0 END)), 0.0)
        - 0.1::DOUBLE * least(2, len(list_filter(p.cats, lambda t: t = c.cat))) AS value
    FROM picks p JOIN near c USING (request_id) WHERE p.step < p.lim AND NOT list_contains(p.names, c.name_norm)
  ) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY value DESC, final DESC, row_ix) = 1
),
shown AS (SELECT request_id, row_ix, rank FROM plain UNION ALL SELECT request_id, row_ix, CAST(step AS INT) FROM picks WHERE step > 0),
hits AS (SELECT request_id, row_ix, list_sort(list(term)) AS matched FROM post JOIN want USING (term) GROUP BY request_id, row_ix),
result AS (
  SELECT s.request_id, rank, s.row_ix, strategy, low, final, semantic, lexical, ingredient, d AS distinctiveness, coalesce(matched, []) AS matched
  FROM shown s JOIN ranked r ON r.request_id = s.request_id AND r.row_ix = s.row_ix LEFT JOIN hits h ON h.request_id = s.request_id AND h.row_ix = s.row_ix
)
"""


def hybrid_search(batch: list, vectors: list) -> str:
    six = ", ".join(f"round({c}, 6) AS {c}" for c in ("final", "semantic", "lexical", "ingredient", "distinctiveness"))
    return hybrid(batch, vectors) + f"SELECT request_id, rank, row_ix, strategy, {six}, array_to_string(matched, ', ') AS matched, {_REASON} AS reason, low AS low_signal FROM result"


def search_metadata(batch: list, vectors: list, discovered: str, adventurous: str, broad: str, closest: str) -> str:
    said = ", ".join(f"({k}, {_str(mode)}, {_str(q.original)}, {_str(q.kind)}, {_str(q.intent)}, {_str(q.warning) if q.warning else 'NULL'})" for k, q, mode, _ in batch)
    return hybrid(batch, vectors) + f"""
SELECT request_id, mode, query, kind, intent, strategy, total_recipes, returned, confidence, true AS semantic_available, false AS semantic_degraded, warning AS retrieval_warning, nullif(concat_ws(' ', lead, own, warning), '') AS notice
FROM (
  SELECT *, CASE WHEN strategy = 'adventurous' THEN {_str(adventurous)} WHEN strategy = 'discovery' AND warning IS NULL THEN {_str(broad)} WHEN confidence = 'low' THEN {_str(closest)} END AS lead
  FROM (
    SELECT *, CASE WHEN strategy = 'discovery' THEN CASE WHEN low THEN 'low' ELSE 'medium' END WHEN strategy <> 'search' THEN 'medium' WHEN best >= 0.55 THEN 'high' WHEN best >= 0.31 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN low THEN {_str(discovered)} END AS warning
    FROM (VALUES {said}) AS s(request_id, mode, query, kind, intent, own) JOIN plan USING (request_id) CROSS JOIN (SELECT count(*) AS total_recipes FROM sample_recipes)
    JOIN (SELECT request_id, count(*) AS returned, max(CASE WHEN rank = 1 THEN final END) AS best FROM result GROUP BY request_id) USING (request_id)
  )
)"""


def _shown_duration(c: str) -> str:
    part = lambda k: f"regexp_extract({c}, '^(?i)PT(?:(\\d+)H)?(?:(\\d+)M)?$', {k})"
    return f"CASE WHEN regexp_matches({c}, '^(?i)PT(\\d+H)?(\\d+M)?$') AND upper({c}) <> 'PT' THEN concat_ws(' ', CASE WHEN {part(1)} <> '' THEN {part(1)} || ' hr' END, CASE WHEN {part(2)} <> '' THEN {part(2)} || ' min' END) ELSE nullif({c}, '') END"


_LABELS = "MAP {" + ", ".join(f"{_str(a)}: {_str(b)}" for a, b in W.SOURCE_LABELS.items()) + "}"
_FACTS = f"""
WITH m AS (SELECT row_ix, ({_MIN('prep_time')}) + ({_MIN('cook_time')}) AS total, {_shown_duration('cook_time')} AS cook, {_shown_duration('prep_time')} AS prep, trim(recipe_yield, ' \t\n\r') AS y, greatest(coalesce(len(ingredients), 0), 0) AS n, trim(source, ' \t\n\r') AS s FROM sample_recipes)
SELECT row_ix, concat_ws(' · ',
  CASE WHEN total IS NOT NULL THEN concat_ws(' ', CASE WHEN total >= 60 THEN (total // 60) || ' hr' END, CASE WHEN total % 60 > 0 OR total < 60 THEN (total % 60) || ' min' END) || ' total time' WHEN cook IS NOT NULL THEN cook || ' cooking time' WHEN prep IS NOT NULL THEN prep || ' preparation time' END,
  CASE WHEN y <> '' AND length(y) <= 36 THEN CASE WHEN regexp_matches(y, '^(?i)makes?\\b') THEN y ELSE 'Makes ' || y END END, n || CASE WHEN n = 1 THEN ' ingredient' ELSE ' ingredients' END) AS facts,
  CASE WHEN s <> '' THEN coalesce(map_extract({_LABELS}, lower(s))[1], regexp_replace(regexp_replace(s, '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')) END AS source_label
FROM m
"""

_bare = lambda x: f"lower(regexp_replace({x}, '\\s+', '', 'g'))"
_STEPS = f"""
WITH a AS (SELECT row_ix, list_filter(list_transform(regexp_split_to_array(instructions, '\\r\\n|\\n|\\r'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM sample_recipes WHERE instructions IS NOT NULL),
b AS (SELECT row_ix, CASE WHEN len(l) > 1 AND {_bare('l[1]')} = {_bare("array_to_string(l[2:], ' ')")} THEN l[2:] ELSE l END AS l FROM a),
c AS (SELECT row_ix, list_filter(l, lambda x, i: i = 1 OR {_bare('x')} <> {_bare('l[i - 1]')}) AS l FROM b),
d AS (SELECT row_ix, list_filter(list_transform(l, lambda x: trim(regexp_replace(x, '^(?i)(?:step\\s*)?\\d+\\s*[.):]\\s*', ''))), lambda x: x <> '') AS s FROM c),
e AS (SELECT row_ix, list_filter(s, lambda x, i: list_position(s, x) = i AND len(list_filter(s[i + 1:], lambda z: length(z) >= 24 AND length(x) > length(z) AND contains(x, z))) = 0) AS s FROM d)
SELECT row_ix, CAST(i - 1 AS INT) AS step_no, s[i] AS step FROM (SELECT row_ix, s, unnest(range(1, len(s) + 1)) AS i FROM e)
"""

#: Why a recipe is shown, in words.
_REASON = """CASE WHEN strategy = 'adventurous' THEN 'Adventurous pick with a less common ingredient combination' WHEN strategy = 'discovery' THEN 'Varied discovery pick from the recipe collection'
WHEN len(matched) > 0 THEN 'Matches ' || array_to_string(matched[:4], ', ') WHEN semantic >= lexical THEN 'Strong meaning-based match' WHEN lexical > 0 THEN 'Matches words in the request' ELSE 'Closest available match' END"""


def linked(least: float, also: str = "") -> str:
    """The best method of each recipe, as CTEs up to ``best``; ``also`` is a further condition on recipe and method."""
    return f"""
WITH {TERMS}, {_NAMES},
mlines AS (SELECT record_key, unnest(ingredients) AS l FROM method_corpus),
mraw AS (SELECT record_key, {_words('l')} AS w FROM mlines WHERE l IS NOT NULL),
mmarked AS (SELECT record_key, list_transform(w, lambda t: CASE WHEN len(t) > 1 AND NOT list_contains({_STOP}, t) THEN {_sing('t')} END) AS m FROM mraw),
mpost AS (
  SELECT DISTINCT record_key, term FROM (
    SELECT record_key, unnest(m) AS term FROM mmarked
    UNION ALL SELECT record_key, unnest(list_transform(range(1, len(m)), lambda i: m[i] || ' ' || m[i + 1])) FROM mmarked
  ) WHERE term IS NOT NULL
),
rn AS (SELECT row_ix, count(*) AS n FROM post GROUP BY row_ix), mn AS (SELECT record_key, count(*) AS n FROM mpost GROUP BY record_key),
titles AS (SELECT names.row_ix, record_key, instructions FROM names JOIN (SELECT record_key, instructions, {norm('title')} AS t FROM method_corpus WHERE instructions <> '') ON name_norm = t{also}),
sh AS (SELECT row_ix, record_key, count(*) AS c FROM titles JOIN post USING (row_ix) JOIN mpost USING (record_key, term) GROUP BY row_ix, record_key),
sc AS (SELECT row_ix, record_key, instructions, c / rn.n AS x, c / mn.n AS y FROM sh JOIN titles USING (row_ix, record_key) JOIN rn USING (row_ix) JOIN mn USING (record_key)),
ok AS (SELECT *, least(x, y) AS score FROM sc WHERE least(x, y) >= {least}),
sure AS (SELECT row_ix FROM ok GROUP BY row_ix HAVING count(DISTINCT instructions) = 1),
best AS (SELECT row_ix, record_key, instructions, round(score, 6) AS score FROM ok JOIN sure USING (row_ix) QUALIFY row_number() OVER (PARTITION BY row_ix ORDER BY score DESC, (x + y) / 2 DESC, record_key) = 1)
"""


_BY_SOURCE = """ AND (row_ix, record_key) IN (SELECT (r.row_ix, m.record_key) FROM sample_recipes r JOIN (SELECT DISTINCT corpus, credit FROM method_corpus WHERE corpus IS NOT NULL AND credit IS NOT NULL) c ON c.credit = r.source JOIN method_corpus m ON m.corpus = c.corpus)"""
_LINES = "list_filter(list_transform(list_filter(ingredients, lambda x: x IS NOT NULL), lambda x: trim(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), 'ADVERTISEMENT', ''), ' \t,-')), lambda x: x <> '')"

SQL: dict[str, str] = {
    "normalize_text": f"SELECT row_ix, {norm('name')} AS name_norm FROM sample_recipes",
    "canonical_urls": f"""
WITH s AS (SELECT row_ix, CASE WHEN regexp_matches({_URL}, '^(?i)https?://[^/?#]+') THEN {_URL} END AS u FROM sample_recipes)
SELECT row_ix, u AS url, regexp_replace({_AUTH}, '^www\\.', '') AS host FROM s
""",
    "durations": f"SELECT row_ix, prep_minutes, cook_minutes, prep_minutes + cook_minutes AS total_minutes FROM (SELECT row_ix, {_MIN('prep_time')} AS prep_minutes, {_MIN('cook_time')} AS cook_minutes FROM sample_recipes)",
    "category_counts": f"SELECT {_CAT} AS category, count(*) AS n FROM (SELECT {norm('name')} AS t FROM sample_recipes) GROUP BY 1",
    "postings": f"WITH {TERMS} SELECT term, row_ix FROM post",
    "document_frequency": f"WITH {TERMS} SELECT term, count(*) AS df FROM post GROUP BY term",
    "distinctiveness": f"WITH {TERMS}, {_DISTINCT} SELECT row_ix, distinctiveness FROM dist",
    "ingredient_topk": f"""
WITH {TERMS}, {_NAMES},
size AS (SELECT row_ix, count(*) AS n, count(*) FILTER (WHERE list_contains({_list(ASKED)}, term)) AS c FROM post GROUP BY row_ix),
s AS (SELECT row_ix, name_norm, least(1.0, 0.8::DOUBLE * c / {len(ASKED)} + 0.2::DOUBLE * c / sqrt({len(ASKED)} * greatest(1, n))) AS score FROM size JOIN names USING (row_ix) WHERE c > 0),
one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY name_norm ORDER BY score DESC, row_ix) = 1)
SELECT row_ix, name_norm, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, row_ix) AS INT) AS rank FROM one QUALIFY rank <= 10
""",
    "exclusions": f"""
WITH {TERMS}, {_NAMES}
SELECT row_ix FROM names WHERE NOT list_contains(string_split(name_norm, ' '), 'spicy')
AND row_ix NOT IN (SELECT row_ix FROM post WHERE list_contains({_list(['garlic clove', 'salmon', *W.SPICY])}, term))
""",
    "lexical_vocabulary": f"WITH {_GRAMS} SELECT gram, df, total, round(idf, 6) AS idf FROM idf",
    "lexical_topk": f"""
WITH {_GRAMS},
qw AS (SELECT ' ' || unnest(string_split('{TEXT}', ' ')) || ' ' AS p),
qg AS (
  SELECT substring(p, i, 3) AS gram FROM (SELECT p, unnest(range(1, len(p) - 1)) AS i FROM qw)
  UNION ALL SELECT substring(p, i, 4) FROM (SELECT p, unnest(range(1, len(p) - 2)) AS i FROM qw WHERE len(p) >= 4)
),
q AS (SELECT gram, (1 + ln(c)) * idf AS x FROM (SELECT gram, count(*) AS c FROM qg GROUP BY gram) JOIN idf USING (gram)),
d AS (SELECT row_ix, gram, (1 + ln(c)) * idf AS x FROM tf JOIN idf USING (gram)),
dn AS (SELECT row_ix, sqrt(sum(x * x)) AS s FROM d GROUP BY row_ix)
SELECT row_ix, round(sum(d.x * q.x) / (any_value(s) * (SELECT sqrt(sum(x * x)) FROM q)), 6) AS lexical
FROM d JOIN q USING (gram) JOIN dn USING (row_ix) GROUP BY row_ix ORDER BY lexical DESC, row_ix LIMIT 10
""",
    "cosine_topk": """
WITH v AS (
  SELECT row_ix, min(CAST(vec AS DOUBLE[])) AS v FROM recipe_vectors
  WHERE vec IS NOT NULL AND len(vec) = 64 AND NOT list_contains(list_transform(vec, lambda x: CAST(x AS VARCHAR) IN ('nan', '-nan')), true) GROUP BY row_ix
), n AS (SELECT row_ix, v, sqrt(list_dot_product(v, v)) AS s FROM v WHERE list_dot_product(v, v) > 0),
q AS (SELECT row_ix AS asked, v AS qv, s AS qs FROM n ORDER BY row_ix LIMIT 1)
SELECT row_ix, round(least(1.0, greatest(0.0, list_dot_product(v, qv) / (s * qs))), 5) AS cosine FROM n, q WHERE row_ix <> asked ORDER BY cosine DESC, row_ix LIMIT 10
""",
    "distinct_titles_topk": f"""
WITH {TERMS}, {_NAMES}, {_DISTINCT},
one AS (SELECT * FROM dist JOIN names USING (row_ix) QUALIFY row_number() OVER (PARTITION BY name_norm ORDER BY distinctiveness DESC, row_ix) = 1)
SELECT row_ix, CAST(row_number() OVER (ORDER BY distinctiveness DESC, row_ix) AS INT) AS rank FROM one QUALIFY rank <= 20
""",
    "strict_linkage": linked(0.5) + "SELECT row_ix, record_key, score FROM best",
    "source_linkage": linked(0.9, _BY_SOURCE) + "SELECT row_ix, record_key, score FROM best",
    "enriched_records": linked(0.5) + """
SELECT r.id AS assignmentRecord, r.name, r.url, b.instructions AS recipeInstructions, coalesce(m.corpus, '') AS instructionCorpus, b.record_key AS instructionRecord, 'strict-title-source-coverage' AS instructionMatcher, score AS instructionMatchScore
FROM best b JOIN sample_recipes r USING (row_ix) JOIN method_corpus m USING (record_key)
""",
    "enrichment_counts": linked(0.5) + """
SELECT (SELECT count(*) FROM sample_recipes) AS recipes_seen, (SELECT count(*) FROM method_corpus) AS methods_seen, CAST(sum(n) AS BIGINT) AS linked, string_agg(corpus || '=' || n, ', ' ORDER BY corpus) AS by_corpus
FROM (SELECT coalesce(m.corpus, '') AS corpus, count(*) AS n FROM best JOIN method_corpus m USING (record_key) GROUP BY 1)
""",
    "ingested": f"""
WITH r AS (SELECT row_ix, nullif(trim(name), '') AS name, {_LINES} AS l, nullif(trim(source), '') AS source, CASE WHEN regexp_matches({_URL}, '^(?i)https?://[^/?#]+') THEN {_URL} END AS u, nullif(trim(prep_time), '') AS prep_time, nullif(trim(recipe_yield), '') AS recipe_yield, instructions FROM sample_recipes)
SELECT row_ix, substring(sha1('delivered.jsonl:' || row_ix || ':' || name), 1, 16) AS id, name, CAST(len(l) AS INT) AS lines, md5(array_to_string(l, '|')) AS lines_md5, coalesce(source, CASE WHEN u IS NOT NULL THEN regexp_replace({_AUTH}, '^www\\.', '') END, 'delivered') AS source, u AS url, prep_time, recipe_yield, CASE WHEN trim(instructions, ' \n\t\r') <> '' THEN 'dataset' END AS instruction_source
FROM r WHERE name IS NOT NULL AND len(l) > 0
""",
    "facts": _FACTS,
    "steps": _STEPS,
    "readiness": "SELECT 'ready' AS status, count(*) AS recipes, count(instructions) AS with_instructions, round_even(count(instructions) / count(*), 4) AS coverage, true AS semantic, false AS model FROM sample_recipes",
    "rate_limit": """
WITH RECURSIVE g AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, ts, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id) >= 60000000 THEN 1 ELSE 0 END AS gap FROM events),
p AS (SELECT *, sum(gap) OVER (ORDER BY ts, event_id) AS piece FROM g),
e AS (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY ts, event_id) AS n FROM p),
r AS (
  SELECT DISTINCT piece, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(c VARCHAR, us BIGINT)[]) AS kept, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS user_id, CAST(NULL AS TIMESTAMP) AS ts, false AS allowed FROM p
  UNION ALL
  SELECT piece, n, CASE WHEN ok THEN list_append(live, {'c': user_id, 'us': us}) ELSE live END, event_id, user_id, ts, ok
  FROM (
    SELECT piece, n, live, event_id, user_id, ts, us, len(live) < 20 AND len(list_filter(live, lambda x: x.c = user_id)) < 5 AS ok
    FROM (SELECT e.*, list_filter(r.kept, lambda x: x.us > e.us - 60000000) AS live FROM r JOIN e ON e.piece = r.piece AND e.n = r.n + 1)
  )
)
SELECT event_id, user_id, ts, allowed FROM r WHERE n > 0
""",
    "hashed_sample": "SELECT row_ix, id FROM sample_recipes ORDER BY md5('20260902:' || CAST(row_ix AS VARCHAR)), row_ix LIMIT 100",
    "round_robin": "SELECT corpus, record_key, CAST(row_number() OVER (PARTITION BY corpus ORDER BY record_key) AS INT) AS turn FROM method_corpus WHERE corpus IS NOT NULL ORDER BY turn, corpus LIMIT 200",
    "json_fields": "SELECT event_type, count(*) AS events, count(k) AS with_k, CAST(sum(k) AS BIGINT) AS sum_k FROM (SELECT event_type, nullif(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events) GROUP BY event_type",
    "coverage": "SELECT coalesce(instruction_source, 'none') AS origin, count(*) AS recipes, (SELECT round_even(avg(CAST(instructions IS NOT NULL AS DOUBLE)), 4) FROM sample_recipes) AS share FROM sample_recipes GROUP BY 1",
}
