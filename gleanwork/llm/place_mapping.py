"""Freely typed countries, states and cities mapped to the entries of a reference list, in SQL.

Pigeonhole join: a reference name is cut into EDITS + 1 segments; a typed name within EDITS edits
holds one of them unchanged, shifted by at most EDITS. Typed names are joined with the segments on
equal substrings and verified with levenshtein. Only distinct typed values are joined; a request
gets the readings of its three boxes back and the entry that fits most of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from gleanwork.operators.skew import join_group_facts
from gleanwork.session import cut

EDITS = 2
#: From this length on a name may differ by two edits that are not a swap of neighbours.
LONG_NAME = 11
#: Names below this length must be typed exactly.
FUZZY_LENGTH = 5

#: Spellings of words in place names, and words that say nothing about the place.
WORD_FORMS = {
    "mt": "mount", "mnt": "mount", "pt": "port", "ft": "fort", "st": "saint", "hts": "heights", "w": "west", "n": "north", "e": "east", "s": "south",
    "prov": "province", "rep": "republic", "repub": "republic", "kgdm": "kingdom", "utd": "united", "o": "on",
}
NOISE = "the all of near nr greater area centre center city state region town downtown central around".split()
TITLES = "kingdom republic united cantons union states federation province".split()
ACCENTS = ("áàâäãåéèêëíìîïóòôöõøúùûüñçýÿ", "aaaaaaeeeeiiiioooooouuuuncyy")


def _words(text: str) -> str:
    """SQL: the words of a typed or listed name, each with abbreviations expanded and as it is written, noise removed."""
    forms = ", ".join(f"'{k}', '{v}'" for k, v in WORD_FORMS.items())
    noise = ", ".join(f"'{w}'" for w in NOISE)
    return f"""filter(transform(regexp_extract_all({text}, '([a-z0-9]+)', 1), w -> struct(coalesce(try_element_at(map({forms}), w), w) AS full, w AS plain)),
        w -> not array_contains(array({noise}), w.full) AND NOT w.full RLIKE '^[0-9]+$')"""


def _clean(text: str) -> str:
    return f"replace(translate(lower({text}), '{ACCENTS[0]}', '{ACCENTS[1]}'), '''', '')"


def _fold(words: str) -> str:
    """SQL: one string for spellings that sound alike."""
    return f"replace(replace(replace(translate(array_join(transform({words}, w -> w.full), ''), 'yw', 'iv'), 'ck', 'k'), 'ks', 'x'), 'ph', 'f')"


def _plain(words: str) -> str:
    """SQL: the words as they are written, in one string."""
    return f"array_join(transform({words}, w -> w.plain), '')"


_FORMS = f"""
WITH listed AS (
  SELECT min(geo_id) AS geo_id, country, state, city, CASE WHEN city IS NOT NULL THEN 3 WHEN state IS NOT NULL THEN 2 ELSE 1 END AS level,
    min(country_code) AS country_code, min(state_code) AS state_code
  FROM {{geo}} WHERE geo_id IS NOT NULL AND country IS NOT NULL GROUP BY country, state, city),
named AS (SELECT *, {_words(_clean("coalesce(city, state, country)"))} AS words FROM listed),
forms AS (
  SELECT geo_id, level, country, state, {_fold("words")} AS form, true AS fuzzy FROM named
  UNION SELECT geo_id, level, country, state, {_plain("words")}, true FROM named
  UNION SELECT geo_id, level, country, state, {_fold(f"filter(words, w -> not array_contains(array({', '.join(repr(t) for t in TITLES)}), w.full))")}, true FROM named WHERE level < 3
  UNION SELECT geo_id, level, country, state, lower(CASE level WHEN 1 THEN country_code ELSE state_code END), false FROM named WHERE level < 3)
SELECT form, fuzzy, collect_list(struct(geo_id, level, country, state)) AS entries FROM forms WHERE form <> '' GROUP BY form, fuzzy
"""

# A span is a whole piece of a typed value (cut 0) or one of the two sides of a cut of it, with words
# spelled out and folded by sound, and as they are written. A piece longer than any two listed
# names has no cut that could be read.
_SPANS = f"""
WITH pieces AS (
  SELECT value, piece, {_words("text")} AS words FROM (
    SELECT value, posexplode(split(regexp_replace({_clean("value")}, 'o/ ?sea', 'on sea'), '[,/;|()]')) AS (piece, text) FROM (SELECT DISTINCT value FROM {{typed}}))),
cuts AS (SELECT *, explode(sequence(0, CASE WHEN length({_plain("words")}) <= 4 * ({{longest}} + {EDITS}) THEN size(words) - 1 ELSE 0 END)) AS cut FROM pieces WHERE size(words) > 0),
sides AS (
  SELECT value, piece, cut, 0 AS side, words FROM cuts WHERE cut = 0
  UNION ALL SELECT value, piece, cut, 1, slice(words, 1, cut) FROM cuts WHERE cut > 0
  UNION ALL SELECT value, piece, cut, 2, slice(words, cut + 1, size(words)) FROM cuts WHERE cut > 0)
SELECT value, piece, cut, side, explode(array_distinct(array({_fold("words")}, {_plain("words")}))) AS text, {_plain("words")} AS plain FROM sides
"""

def _cut_at(nr: str, whole: str) -> str:
    return f"CAST(floor(({nr}) * {whole} / {EDITS + 1}) AS INT)"


_SEGMENTS = f"""
SELECT form, entries, length(form) AS whole, nr,
  substring(form, {_cut_at("nr", "length(form)")} + 1, {_cut_at("nr + 1", "length(form)")} - {_cut_at("nr", "length(form)")}) AS segment
FROM (SELECT *, explode(sequence(0, {EDITS})) AS nr FROM {{forms}} WHERE fuzzy AND length(form) >= {FUZZY_LENGTH})
"""

_PROBES = f"""
WITH texts AS (SELECT DISTINCT text FROM {{spans}} WHERE length(text) >= {FUZZY_LENGTH} - 1 AND length(text) <= {{longest}} + {EDITS}),
lengths AS (SELECT text, explode(sequence(greatest({FUZZY_LENGTH}, length(text) - {EDITS}), length(text) + {EDITS})) AS whole FROM texts),
parts AS (SELECT text, whole, explode(sequence(0, {EDITS})) AS nr FROM lengths),
placed AS (SELECT *, {_cut_at("nr", "whole")} AS start, {_cut_at("nr + 1", "whole")} - {_cut_at("nr", "whole")} AS size FROM parts),
moved AS (SELECT *, explode(sequence(start - {EDITS}, start + {EDITS})) AS at FROM placed)
SELECT DISTINCT text, whole, nr, substring(text, at + 1, size) AS segment FROM moved WHERE at >= 0 AND at + size <= length(text)
"""

_MATCHES = f"""
WITH near AS (
  SELECT text, form, any_value(entries) AS entries, levenshtein(text, form) AS edits FROM {{probes}} JOIN {{segments}} USING (whole, nr, segment)
  WHERE levenshtein(text, form, {EDITS}) >= 0 GROUP BY text, form),
kept AS (
  SELECT text, edits, entries FROM near WHERE edits <= 1 OR length(text) >= {LONG_NAME} OR array_sort(split(text, '')) = array_sort(split(form, ''))
  UNION ALL SELECT s.text, 0, f.entries FROM (SELECT DISTINCT text FROM {{spans}}) s JOIN (SELECT form AS text, entries FROM {{forms}} WHERE fuzzy) f USING (text)
  UNION ALL SELECT s.text, 0, f.entries FROM (SELECT DISTINCT text, plain FROM {{spans}} WHERE length(plain) <= 4) s JOIN {{forms}} f ON s.plain = f.form AND NOT f.fuzzy),
best AS (SELECT text, min(edits) AS edits FROM kept GROUP BY text)
SELECT text, edits, array_distinct(flatten(collect_list(entries))) AS entries FROM kept JOIN best USING (text, edits) GROUP BY text, edits
"""

# The mentions of a value: of each piece its whole if that is listed, else its best cut. A value
# whose first piece names nothing ('Nowhere, Listed State') has none.
_READINGS = """
WITH found AS (
  SELECT value, piece, cut, side, min_by(struct(edits, entries), struct(edits, text)) AS mention FROM {spans} JOIN {matches} USING (text) GROUP BY value, piece, cut, side),
covers AS (
  SELECT value, piece, cut, collect_list(mention) AS mentions, sum(mention.edits) AS edits FROM found
  GROUP BY value, piece, cut HAVING count(*) = CASE WHEN cut = 0 THEN 1 ELSE 2 END),
best AS (SELECT value, piece, min_by(mentions, struct(cut > 0, edits, cut)) AS mentions FROM covers GROUP BY value, piece),
opening AS (SELECT value, min(piece) AS piece FROM {spans} GROUP BY value)
SELECT value, flatten(collect_list(mentions)) AS mentions FROM best JOIN opening USING (value) GROUP BY value
HAVING min(best.piece) = min(opening.piece)
"""

_BOXES = """
SELECT request_id, nullif(trim(regexp_replace(country, '[\\\\s\\u00a0]+', ' ')), '') AS country, nullif(trim(regexp_replace(state, '[\\\\s\\u00a0]+', ' ')), '') AS state,
  nullif(trim(regexp_replace(city, '[\\\\s\\u00a0]+', ' ')), '') AS city FROM {requests} WHERE request_id IS NOT NULL
"""

_TRIPLE = "concat_ws('\\u0001', coalesce(country, '\\u0002'), coalesce(state, '\\u0002'), coalesce(city, '\\u0002'))"
_FITS = "exists({m}.entries, x -> x.country = c.country AND CASE x.level WHEN 1 THEN true WHEN 2 THEN x.state = c.state ELSE x.geo_id = c.geo_id END)"
_CHOICE = f"""
WITH own AS (
  SELECT country, state, city, flatten(collect_list(mentions)) AS mentions,
    flatten(collect_list(mentions) FILTER (WHERE box = CASE WHEN city IS NOT NULL THEN 3 WHEN state IS NOT NULL THEN 2 ELSE 1 END)) AS finest
  FROM {{read}} GROUP BY country, state, city),
scored AS (
  SELECT country, state, city, transform(
    filter(array_distinct(flatten(transform(mentions, m -> m.entries))), c -> size(finest) > 0 AND forall(finest, m -> {_FITS.format(m="m")})),
    c -> struct(c.level AS level, size(filter(mentions, m -> {_FITS.format(m="m")})) AS fitting,
      -aggregate(mentions, 0, (n, m) -> n + CASE WHEN exists(m.entries, x -> x.geo_id = c.geo_id) THEN m.edits ELSE 0 END) AS closeness, -c.geo_id AS nr)) AS choices FROM own)
SELECT {_TRIPLE} AS triple, coalesce(-array_max(choices).nr, 0) AS geo_id FROM scored
"""


def map_places(requests: DataFrame, geo: DataFrame) -> DataFrame:
    """(request_id, geo_id) for each request with country, state or city not blank.

    geo_id is the entry of ``geo`` that the typed values name together, at the finest level typed;
    0 where the finest box filled names nothing listed. Nulls count as blank; a repeated request
    with the same values counts once; of equally good entries the smallest geo_id is taken. An
    empty reference list maps everything to 0. Other columns are not read.
    """
    spark = requests.sparkSession
    boxes = spark.sql(_BOXES, requests=requests).filter("coalesce(country, state, city) is not null").distinct()
    triples = cut(boxes.groupBy("country", "state", "city").count())
    typed = spark.sql("SELECT country, state, city, value, at + 1 AS box FROM (SELECT country, state, city, posexplode(array(country, state, city)) AS (at, value) FROM {triples}) WHERE value IS NOT NULL", triples=triples)
    forms = cut(spark.sql(_FORMS, geo=geo))
    longest = forms.selectExpr("coalesce(max(length(form)), 0)").first()[0]
    spans = cut(spark.sql(_SPANS, typed=typed, longest=longest))
    matches = cut(spark.sql(_MATCHES, probes=spark.sql(_PROBES, spans=spans, longest=longest), segments=spark.sql(_SEGMENTS, forms=forms), spans=spans, forms=forms))
    readings = spark.sql(_READINGS, spans=spans, matches=matches)
    facts = spark.sql("SELECT value, mentions, n FROM {readings} JOIN (SELECT value, count(*) AS n FROM {typed} GROUP BY value) USING (value)", readings=readings, typed=typed)
    read = join_group_facts(typed, cut(facts), "value", "n", typed.count()).select("country", "state", "city", "box", "mentions")
    chosen = spark.sql(_CHOICE, read=read)
    chosen = spark.sql(f"SELECT triple, n, coalesce(geo_id, 0) AS geo_id FROM (SELECT {_TRIPLE} AS triple, count AS n FROM {{triples}}) LEFT JOIN {{chosen}} USING (triple)", triples=triples, chosen=chosen)
    return join_group_facts(boxes.selectExpr("request_id", f"{_TRIPLE} AS triple"), cut(chosen), "triple", "n", boxes.count()).select("request_id", "geo_id")
