"""SQL for DuckDB that makes the company records one step after the other, in order."""

from __future__ import annotations

from collections.abc import Callable

from gleanwork.functions import constants as C

_ORDERED = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def _merge(source: str, target: str, other: str) -> str:
    """A step: what the site still lacks is taken from ``other``, unless it has e-mail, phone and address."""
    empty = lambda c: f"len({c}) = 0"
    more = f"({other} IS NOT NULL AND NOT (len(email) > 0 AND len(phone) > 0 AND address <> ''))"
    joined = lambda c, most: f"CASE WHEN {more} THEN list_slice(list_concat({c}, " + _ORDERED.format(f"list_filter({other}.{c}, lambda v: NOT list_contains({c}, v))") + f"), 1, greatest(len({c}), {most})) ELSE {c} END"
    first = lambda c: f"CASE WHEN {more} AND coalesce({c}, '') = '' THEN {other}.{c} ELSE {c} END"
    gained = f"(({empty('email')} AND len({other}.email) > 0) OR ({empty('phone')} AND len({other}.phone) > 0) OR (address = '' AND {other}.address <> ''))"
    kept = "domain, first_id, home, first, second"
    return f"{target} AS (SELECT {kept}, {joined('email', 3)} AS email, {joined('phone', 2)} AS phone, {first('address')} AS address, {first('services')} AS services, {first('name')} AS name, CASE WHEN {more} AND {gained} THEN {other}.url ELSE page END AS page FROM {source})"


def company_records(host: Callable, root: Callable, skip: Callable, clean: Callable, name: Callable, phone: Callable, places: str, log: str, reasons: bool = False) -> str:
    """The whole pipeline; the arguments write the SQL of single columns, and of the tables that count a key once.

    With ``reasons`` it ends with the number and mean score of the candidates by the reason against them.
    """
    with_scheme = lambda c: f"CASE WHEN contains(coalesce({c}, ''), '://') THEN coalesce({c}, '') ELSE 'http://' || coalesce({c}, '') END"
    site = lambda c: f"lower(regexp_extract({with_scheme(c)}, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+)', 1))"
    said = f"{{'url': url, 'name': name, 'email': coalesce(email, []::VARCHAR[]), 'phone': coalesce(phone, []::VARCHAR[]), 'address': {clean('address')}, 'services': {clean('services')}}}"
    bad = f"regexp_matches(coalesce(company_name, ''), '{C.MEDIA_NAME}', 'i') OR regexp_matches(coalesce(company_name, ''), '{C.JUNK_NAME}', 'i')"
    mail, call = "array_to_string(email, '; ')", "array_to_string(phone, '; ')"
    reason = (
        f"CASE WHEN length(company_name) < 3 OR {name('company_name')} = '' THEN 'no plausible company name' WHEN {bad} THEN 'name looks like publisher or article' WHEN official_website <> '' AND skipped THEN 'website is a directory, social or media domain' "
        f"WHEN official_website = '' AND (seq >= 1125899906842624 OR cid = '') THEN 'no official website and not a listing' WHEN {mail} = '' AND {call} = '' AND full_business_address = '' AND official_website = '' THEN 'no useful business attribute' ELSE '' END"
    )
    terms = "list_filter(string_split_regex(lower(category), '[^a-z]+'), lambda t: length(t) > 3)"
    blob = "lower(array_to_string(list_filter([company_name, services, search_query], lambda t: t <> ''), ' '))"
    score = (
        f"least(100, (official_website <> '')::INT * 25 + ({mail} <> '')::INT * 20 + ({call} <> '')::INT * 20 + (full_business_address <> '')::INT * 15 "
        f"+ (company_name <> '' AND company_name <> official_website AND contains(trim(company_name, ' '), ' '))::INT * 10 + coalesce(list_bool_or(list_transform({terms}, lambda t: contains({blob}, t))), false)::INT * 10)"
    )
    domain = host("official_website")
    keys = (
        f"list_distinct(list_filter(list_concat([CASE WHEN {domain} <> '' THEN 'd' || {domain} WHEN cid <> '' THEN 'dcid:' || cid ELSE '' END, CASE WHEN {name('company_name')} <> '' THEN 'no plausible company name' || {name('company_name')} ELSE '' END], "
        f"list_concat(list_transform(email, lambda e: CASE WHEN trim(e) <> '' THEN 'e' || lower(trim(e)) ELSE '' END), list_transform(phone, lambda q: CASE WHEN {phone('q')} <> '' THEN 'p' || {phone('q')} ELSE '' END))), lambda k: k <> ''))"
    )
    bare = lambda c: f"trim(regexp_replace({c}, '{C.POSTCODE}', '', 'g'), ' ')"
    fits = lambda c: f"CASE WHEN {c} <> '' AND NOT regexp_matches({c}, '[0-9]') AND length({c}) <= 40 THEN {c} ELSE '' END"
    countries = ", ".join(repr(x) for x in C.COUNTRIES)
    columns = "seq, company_name, category, official_website, email, phone, full_business_address, industry, services, cid, search_query, source_url, source_page"
    judged = (
        f"WITH RECURSIVE {log}, {places}, asked AS (SELECT seq, max(query) AS q FROM log GROUP BY seq), pgs AS (SELECT DISTINCT ON (extract_id) * FROM extracted WHERE extract_id IS NOT NULL), "
        f"pd AS (SELECT extract_id, {host('url')} AS domain, lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.\\-]*://)?[^/?#]*(.*)$', 1)) AS path, {said} AS said FROM pgs), pu AS (SELECT * FROM pd WHERE domain <> ''), "
        "hm AS (SELECT domain, arg_min(said, {'a': length(path), 'b': extract_id}) AS home, min(extract_id) AS first_id FROM pu GROUP BY domain), "
        f"ct AS (SELECT domain, said, row_number() OVER (PARTITION BY domain ORDER BY NOT contains(path, 'contact'), extract_id) AS n FROM pu WHERE regexp_matches(path, '{C.CONTACT_LINK}', 'i')), "
        "st AS (SELECT hm.*, a.said AS first, b.said AS second FROM hm LEFT JOIN ct a ON a.domain = hm.domain AND a.n = 1 LEFT JOIN ct b ON b.domain = hm.domain AND b.n = 2), "
        "s0 AS (SELECT domain, first_id, home, first, second, home.email AS email, home.phone AS phone, home.address AS address, home.services AS services, home.name AS name, home.url AS page FROM st), "
        f"{_merge('s0', 's1', 'first')}, {_merge('s1', 's2', 'second')}, "
        "ls AS (SELECT s0.domain, CASE WHEN len(s0.email) = 0 THEN s1.email ELSE s0.email END AS email, CASE WHEN len(s0.email) = 0 THEN s1.services ELSE s0.services END AS services, CASE WHEN len(s0.email) = 0 THEN s1.page ELSE s0.page END AS page FROM s0 JOIN s1 USING (domain)), "
        f"hp AS (SELECT *, {host('website')} AS wd FROM pl), rp AS (SELECT *, {root('wd')} AS wr FROM hp), "
        f"lc AS (SELECT place_key AS seq, left({clean('title')}, 150) AS company_name, coalesce(rp.category, '') AS category, CASE WHEN {skip('wr')} THEN '' ELSE {site('website')} END AS official_website, {clean('phonenumber')} AS said_phone, {clean('rp.address')} AS full_business_address, {clean('rp.category')} AS industry, coalesce(cid, '') AS cid, coalesce(q, '') AS search_query FROM rp LEFT JOIN asked USING (seq)), "
        f"ld AS (SELECT *, {host('official_website')} AS dm FROM lc), "
        "l2 AS (SELECT seq, company_name, category, official_website, list_slice(coalesce(ls.email, []::VARCHAR[]), 1, 3) AS email, list_filter([said_phone], lambda x: x <> '') AS phone, full_business_address, industry, left(array_to_string(list_filter([industry, coalesce(ls.services, '')], lambda x: x <> ''), ' | '), 500) AS services, cid, search_query, CASE WHEN cid <> '' THEN 'listing:' || cid ELSE 'listing' END AS source_url, coalesce(ls.page, '') AS source_page FROM ld LEFT JOIN ls ON ls.domain = ld.dm AND ld.dm <> ''), "
        f"fr AS (SELECT *, {root('domain')} AS wr FROM s2 WHERE domain NOT IN (SELECT wd FROM hp WHERE wd <> '')), "
        f"pc AS (SELECT first_id + 1125899906842624 AS seq, left({clean("CASE WHEN coalesce(name, '') <> '' THEN name ELSE domain END")}, 150) AS company_name, '' AS category, {site('home.url')} AS official_website, list_slice(email, 1, 3) AS email, list_slice(phone, 1, 2) AS phone, address AS full_business_address, '' AS industry, left(services, 500) AS services, '' AS cid, '' AS search_query, home.url AS source_url, page AS source_page FROM fr WHERE NOT {skip('wr')} AND (len(email) > 0 OR len(phone) > 0)), "
        f"al AS (SELECT {columns} FROM l2 UNION ALL SELECT {columns} FROM pc), ah AS (SELECT *, {host('official_website')} AS od FROM al), ar AS (SELECT *, {root('od')} AS orr FROM ah), ak AS (SELECT *, {skip('orr')} AS skipped FROM ar)"
    )
    if reasons:
        return f"{judged} SELECT {reason} AS reason, count(*) AS n, round(avg({score}), 6) AS score FROM ak GROUP BY 1"
    return (
        f"{judged}, gd AS (SELECT {columns}, {score} AS score, {keys} AS keys, row_number() OVER (ORDER BY seq) AS i FROM ak WHERE {reason} = ''), "
        "fo AS (SELECT 0::BIGINT AS i, 0::BIGINT AS seq, false AS accepted, []::VARCHAR[] AS acc UNION ALL SELECT gd.i, gd.seq, NOT list_has_any(fo.acc, gd.keys), CASE WHEN list_has_any(fo.acc, gd.keys) THEN fo.acc ELSE list_concat(fo.acc, gd.keys) END FROM fo JOIN gd ON gd.i = fo.i + 1), "
        f"kp AS (SELECT gd.*, list_filter(list_transform(string_split(full_business_address, ','), lambda x: {clean('x')}), lambda x: x <> '') AS parts FROM gd JOIN fo USING (i) WHERE fo.accepted), "
        f"c1 AS (SELECT *, CASE WHEN lower(coalesce(parts[-1], '')) IN ({countries}) THEN parts[-1] ELSE '' END AS country FROM kp), c2 AS (SELECT *, CASE WHEN country <> '' THEN parts[:-2] ELSE parts END AS rest FROM c1), c3 AS (SELECT *, {bare("coalesce(rest[-1], '')")} AS st FROM c2), "
        f"c4 AS (SELECT *, {fits('st')} AS state FROM c3), c5 AS (SELECT *, CASE WHEN state <> '' THEN rest[:-2] ELSE rest END AS more FROM c4), c6 AS (SELECT *, {bare("coalesce(more[-1], '')")} AS cn FROM c5) "
        f"SELECT seq, company_name, category, official_website, full_business_address, industry, services, search_query, source_url, source_page, score, {fits('cn')} AS city, state, country, {mail} AS business_email, {call} AS business_phone FROM c6"
    )
