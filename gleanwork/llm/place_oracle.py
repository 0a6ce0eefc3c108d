"""SQL for DuckDB that maps typed places by comparing all typed with all listed names."""

from __future__ import annotations

from gleanwork.llm import place_mapping as P


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_FORM_OF = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.WORD_FORMS.items()) + " ELSE w END"


def _words(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, '[a-z0-9]+'), lambda w: {{'f': {_FORM_OF}, 'p': w}}), lambda v: NOT list_contains({_list(P.NOISE)}, v.f) AND NOT regexp_matches(v.f, '^[0-9]+$'))"


def _clean(text: str) -> str:
    return f"replace(translate(lower({text}), '{P.ACCENTS[0]}', '{P.ACCENTS[1]}'), '''', '')"


def _fold(words: str) -> str:
    return f"replace(replace(replace(translate(array_to_string(list_transform({words}, lambda x: x.f), ''), 'yw', 'iv'), 'ck', 'k'), 'ks', 'x'), 'ph', 'f')"


def _plain(words: str) -> str:
    return f"array_to_string(list_transform({words}, lambda x: x.p), '')"


_BOX = "nullif(trim(regexp_replace({0}, '[\\s\\x{{00A0}}]+', ' ', 'g'), ' '), '')"

SQL = f"""
WITH boxes AS (
  SELECT DISTINCT request_id, {_BOX.format("country")} AS country, {_BOX.format("state")} AS state, {_BOX.format("city")} AS city FROM collect_requests WHERE request_id IS NOT NULL),
b AS (SELECT *, row_number() OVER () AS nr FROM (SELECT DISTINCT country, state, city FROM boxes WHERE coalesce(country, state, city) IS NOT NULL)),
typed AS (SELECT nr, 1 AS box, country AS value FROM b WHERE country IS NOT NULL UNION ALL SELECT nr, 2, state FROM b WHERE state IS NOT NULL UNION ALL SELECT nr, 3, city FROM b WHERE city IS NOT NULL),
listed AS (SELECT min(geo_id) AS geo_id, country, state, city, CASE WHEN city IS NOT NULL THEN 3 WHEN state IS NOT NULL THEN 2 ELSE 1 END AS level, any_value(country_code) AS country_code, any_value(state_code) AS state_code
  FROM geo_list WHERE geo_id IS NOT NULL AND country IS NOT NULL GROUP BY country, state, city),
named AS (SELECT *, {_words(_clean("coalesce(city, state, country)"))} AS words FROM listed),
forms AS (SELECT geo_id, level, country, state, {_fold("words")} AS form, true AS fuzzy FROM named
  UNION SELECT geo_id, level, country, state, {_plain("words")}, true FROM named
  UNION SELECT geo_id, level, country, state, {_fold(f"list_filter(words, lambda u: NOT list_contains({_list(P.TITLES)}, u.f))")}, true FROM named WHERE level < 3
  UNION SELECT geo_id, level, country, state, lower(CASE level WHEN 1 THEN country_code ELSE state_code END), false FROM named WHERE level < 3),
parts AS (SELECT value, unnest(list_zip(range(len(l)), l)) AS p FROM (SELECT value, regexp_split_to_array(regexp_replace({_clean("value")}, 'o/ ?sea', 'on sea', 'g'), '[,/;|()]') AS l FROM (SELECT DISTINCT value FROM typed))),
pieces AS (SELECT value, p[1] AS piece, {_words("p[2]")} AS words FROM parts),
cuts AS (SELECT value, piece, words, unnest(range(len(words))) AS cut FROM pieces WHERE len(words) > 0),
sides AS (SELECT value, piece, cut, 0 AS side, words AS w FROM cuts WHERE cut = 0 UNION ALL SELECT value, piece, cut, 1, words[1:cut] FROM cuts WHERE cut > 0 UNION ALL SELECT value, piece, cut, 2, words[cut + 1:] FROM cuts WHERE cut > 0),
spans AS (SELECT value, piece, cut, side, unnest(list_distinct([{_fold("w")}, {_plain("w")}])) AS text, {_plain("w")} AS plain FROM sides),
kept AS (
  SELECT DISTINCT s.text, levenshtein(s.text, f.form) AS edits, f.geo_id, f.level, f.country, f.state FROM (SELECT DISTINCT text FROM spans WHERE length(text) >= {P.FUZZY_LENGTH - 1}) s JOIN forms f
    ON f.fuzzy AND f.form <> '' AND length(f.form) >= {P.FUZZY_LENGTH} AND abs(length(f.form) - length(s.text)) <= {P.EDITS} AND levenshtein(s.text, f.form) <= {P.EDITS}
    AND (levenshtein(s.text, f.form) <= 1 OR length(s.text) >= {P.LONG_NAME} OR list_sort(string_split(s.text, '')) = list_sort(string_split(f.form, '')))
  UNION SELECT s.text, 0, f.geo_id, f.level, f.country, f.state FROM spans s JOIN forms f ON f.fuzzy AND f.form = s.text AND f.form <> ''
  UNION SELECT s.text, 0, f.geo_id, f.level, f.country, f.state FROM spans s JOIN forms f ON NOT f.fuzzy AND f.form = s.plain AND f.form <> '' AND length(s.plain) <= 4),
best AS (SELECT text, min(edits) AS edits FROM kept GROUP BY text),
found AS (SELECT value, piece, cut, side, text, edits FROM spans JOIN best USING (text) QUALIFY row_number() OVER (PARTITION BY value, piece, cut, side ORDER BY edits, text) = 1),
covers AS (SELECT value, piece, cut, sum(edits) AS edits FROM found GROUP BY value, piece, cut HAVING count(*) = CASE WHEN cut = 0 THEN 1 ELSE 2 END),
chosen AS (SELECT * FROM covers QUALIFY row_number() OVER (PARTITION BY value, piece ORDER BY cut > 0, edits, cut) = 1),
opening AS (SELECT value, min(piece) AS piece FROM spans GROUP BY value),
good AS (SELECT c.value FROM chosen c JOIN opening o USING (value) GROUP BY value HAVING min(c.piece) = min(o.piece)),
mentions AS (SELECT c.value, c.piece, b2.side, b2.edits, k.geo_id, k.level, k.country, k.state FROM chosen c JOIN good USING (value) JOIN found b2 USING (value, piece, cut) JOIN kept k ON k.text = b2.text AND k.edits = b2.edits),
own AS (SELECT t.nr, t.box, m.* FROM typed t JOIN mentions m USING (value)),
deciding AS (SELECT nr, max(box) AS box FROM typed GROUP BY nr),
candidates AS (SELECT DISTINCT nr, geo_id, level, country, state FROM own),
fits AS (SELECT c.nr, c.geo_id, c.level, o.box, o.piece, o.side, any_value(o.edits) AS edits,
    bool_or(o.country = c.country AND CASE o.level WHEN 1 THEN true WHEN 2 THEN o.state IS NOT DISTINCT FROM c.state AND c.state IS NOT NULL ELSE o.geo_id = c.geo_id END) AS fit, bool_or(o.geo_id = c.geo_id) AS itself
  FROM candidates c JOIN own o ON o.nr = c.nr GROUP BY c.nr, c.geo_id, c.level, o.box, o.piece, o.side),
scored AS (SELECT f.nr, f.geo_id, f.level, count(*) FILTER (WHERE fit) AS fitting, sum(CASE WHEN itself THEN edits ELSE 0 END) AS edits FROM fits f JOIN deciding d ON d.nr = f.nr
  GROUP BY f.nr, f.geo_id, f.level HAVING bool_and(fit OR f.box <> d.box) AND bool_or(f.box = d.box)),
won AS (SELECT nr, geo_id FROM scored QUALIFY row_number() OVER (PARTITION BY nr ORDER BY level DESC, fitting DESC, edits, geo_id) = 1)
SELECT x.request_id, coalesce(w.geo_id, 0) AS geo_id FROM boxes x JOIN b ON b.country IS NOT DISTINCT FROM x.country AND b.state IS NOT DISTINCT FROM x.state AND b.city IS NOT DISTINCT FROM x.city LEFT JOIN won w USING (nr)
"""
