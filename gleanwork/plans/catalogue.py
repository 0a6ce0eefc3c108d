"""The engine's own queries over the test tables, by name, and the SQL that checks them.

The tables deliver some rows twice; SQL and queries count a key once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.functions import constants as C
from gleanwork.functions import html as H
from gleanwork.functions import rules
from gleanwork.functions import text as X
from gleanwork.operators import dedup, folds, ledger, phrases, planner, summary
from gleanwork.plans import record_sql
from gleanwork.plans import records as R
from gleanwork.session import table
from gleanwork.sources import search

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, run: Query, sql: str | None = None) -> None:
    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


def log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "search_log").filter("seq is not null").dropDuplicates(["seq"])


def places(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "places").filter("place_key is not null").dropDuplicates(["place_key"])


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "extracted").filter("extract_id is not null").dropDuplicates(["extract_id"])


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return R.records(table(spark, sf, "places"), table(spark, sf, "search_log"), pages(spark, sf))


def valid(spark: SparkSession, sf: str) -> DataFrame:
    return R.valid_by_search(places(spark, sf))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Collection requests with their keywords as an array and the place asked for, blank where it is null."""
    r = table(spark, sf, "collect_requests").filter("request_id is not null").dropDuplicates(["request_id"])
    return r.withColumn("keys", F.filter(F.transform(F.split(X.text(F.col("keywords")), ","), F.trim), lambda k: k != "")).withColumn("named", F.coalesce(F.when(F.trim("custom_category") != "", F.col("custom_category")), "category", F.lit("")))


_LOG = "log AS (SELECT DISTINCT * FROM search_log WHERE seq IS NOT NULL)"
_PLACES = "pl AS (SELECT DISTINCT * FROM places WHERE place_key IS NOT NULL)"
_PAGES = "pg AS (SELECT DISTINCT extract_id, url, crawled_at, origin, name, address, services FROM extracted WHERE extract_id IS NOT NULL)"
_HOST = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(CASE WHEN contains({0}, '://') THEN {0} ELSE 'http://' || {0} END, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)), '^.*@', ''), ':.*$', ''), '^www\\.', '')"
_LABELS = "list_filter(string_split({0}, '.'), lambda x: x <> '')"


def _host(col: str) -> str:
    return _HOST.format(f"coalesce({col}, '')")


def _root(domain: str) -> str:
    second = ", ".join(f"'{w}'" for w in C.SECOND_LEVEL)
    parts = _LABELS.format(domain)
    return f"CASE WHEN len({parts}) >= 3 AND list_contains([{second}], ({parts})[-2]) AND length(({parts})[-1]) = 2 THEN array_to_string(({parts})[-3:], '.') WHEN len({parts}) >= 2 THEN array_to_string(({parts})[-2:], '.') ELSE {domain} END"


def _name(col: str) -> str:
    n = f"regexp_replace(regexp_replace(lower(coalesce({col}, '')), '{C.LEGAL_SUFFIXES}', ' ', 'gi'), '[^a-z0-9]+', '', 'g')"
    return f"CASE WHEN length({n}) >= 4 THEN {n} ELSE '' END"


def _phone(col: str) -> str:
    d = f"regexp_replace(coalesce({col}, ''), '\\D', '', 'g')"
    return f"CASE WHEN length({d}) >= 8 THEN right({d}, 10) ELSE '' END"


def _clean(col: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({col}, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '[\\s\\x{{00A0}}\\x{{2003}}]+', ' ', 'g'))".replace("{{", "{").replace("}}", "}")


_STEM = "list_transform(regexp_extract_all(lower({0}), '[a-z0-9&+#]+'), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END)"


def _canon(phrase: str) -> str:
    stems = _STEM.format(phrase)
    words = ", ".join(f"'{w}'" for w in [*C.FILLER_WORDS, *C.BUSINESS_NOUNS])
    kept = f"list_filter({stems}, lambda v: NOT list_contains([{words}], v))"
    return f"array_to_string(list_sort(list_distinct(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {stems} END)), ' ')"


_Q = "trim(regexp_replace(lower(coalesce(query, '')), '[\\s\\x{00A0}\\x{2003}]+', ' ', 'g'))"
_SPLIT = f"spl AS (SELECT *, CASE WHEN regexp_matches({_Q}, '^.* in .*$') THEN regexp_extract({_Q}, '^(.*) in (.*)$', 1) ELSE {_Q} END AS ph, CASE WHEN regexp_matches({_Q}, '^.* in .*$') THEN regexp_extract({_Q}, '^(.*) in (.*)$', 2) ELSE '' END AS ge FROM log)"
_KEYED = f"{_LOG}, {_SPLIT}, keyed AS (SELECT *, {_canon('ph')} AS phrase, array_to_string(regexp_extract_all(lower(ge), '[a-z0-9]+'), ' ') AS place FROM spl)"
_LKEY = "coalesce(kind, '') || '|' || phrase || '@' || place || '|p' || CASE WHEN coalesce(page, 0) = 0 THEN 1 ELSE page END"
_SKIP = ", ".join(f"'{d}'" for d in C.SKIP_DOMAINS)
_AGG = ", ".join(f"'{d}'" for d in C.AGGREGATOR_DOMAINS)


def _skip(root: str) -> str:
    return f"({root} = '' OR {root} IN ({_SKIP}) OR regexp_matches({root}, '\\.(gov|edu|mil)$|\\.(gov|edu|ac)\\.') OR regexp_matches(regexp_replace({root}, '\\.[^.]*$', ''), '{C.MEDIA_DOMAIN}', 'i'))"


# URLs, names, contacts
_query("url_domains", lambda s, d: places(s, d).select("place_key", X.norm_domain(F.col("website")).alias("domain"), X.root_domain(F.col("website")).alias("root"), X.is_skip_domain(F.col("website")).alias("skip"), X.is_aggregator(F.col("website")).alias("aggregator")),
       f"WITH {_PLACES}, h AS (SELECT place_key, {_host('website')} AS domain FROM pl), r AS (SELECT *, {_root('domain')} AS root FROM h) SELECT place_key, domain, root, {_skip('root')} AS skip, root IN ({_AGG}) AS aggregator FROM r")
_PATH = "regexp_replace(regexp_extract(CASE WHEN contains({0}, '://') THEN {0} ELSE 'http://' || {0} END, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//[^/?#]*([^?#]*)', 1), '/+$', '')"
_query("url_crawl_keys", lambda s, d: pages(s, d).select("extract_id", X.crawl_key(F.col("url")).alias("crawl_key"), X.site_url(F.col("url")).alias("site")),
       f"WITH {_PAGES}, h AS (SELECT extract_id, coalesce(url, '') AS u, {_host('url')} AS domain FROM pg), r AS (SELECT *, {_root('domain')} AS root FROM h), k AS (SELECT *, {_skip('root')} AS skip FROM r) "
       f"SELECT extract_id, CASE WHEN skip THEN lower(domain || {_PATH.format('u')}) ELSE domain END AS crawl_key, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+') THEN lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+)', 1)) ELSE '' END AS site FROM k")
_query("url_blocks", lambda s, d: pages(s, d).select("extract_id", X.url_block_reason(F.col("url")).alias("blocked")),
       f"WITH {_PAGES}, u AS (SELECT extract_id, coalesce(url, '') AS u FROM pg), p AS (SELECT extract_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS scheme, lower(regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '^.*@', '')) AS host FROM u), q AS (SELECT extract_id, scheme, regexp_replace(host, ':[0-9]+$', '') AS host, regexp_extract(host, ':([0-9]+)$', 1) AS port FROM p) "
       "SELECT extract_id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN host = '' THEN 'host' WHEN port NOT IN ('', '80', '443', '8080', '8443') THEN 'port' WHEN regexp_matches(host, '^localhost$|^metadata\\.|\\.(local|internal|localhost|lan|home|corp)$') THEN 'name' "
       "WHEN regexp_matches(host, '^([0-9]+|0x[0-9a-f]+)(\\.([0-9]+|0x[0-9a-f]+)){0,3}\\.?$') AND (NOT regexp_matches(host, '^(0|[1-9][0-9]{0,2})(\\.(0|[1-9][0-9]{0,2})){3}$') OR regexp_matches(host, '^(127|10|0)\\.|^192\\.168\\.|^169\\.254\\.|^172\\.(1[6-9]|2[0-9]|3[01])\\.|^100\\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\\.|^2(2[4-9]|[3-5][0-9])\\.')) THEN 'address' WHEN host LIKE '[%' THEN 'address' ELSE '' END AS blocked FROM q")
_query("name_keys", lambda s, d: places(s, d).select("place_key", X.norm_name(F.col("title")).alias("name_key"), X.norm_phone(F.col("phonenumber")).alias("phone_key")),
       f"WITH {_PLACES} SELECT place_key, {_name('title')} AS name_key, {_phone('phonenumber')} AS phone_key FROM pl")
_query("contact_keys", lambda s, d: pages(s, d).select("extract_id", F.explode(F.concat(F.transform(F.coalesce("email", F.array().cast("array<string>")), X.norm_email), F.transform(F.coalesce("phone", F.array().cast("array<string>")), X.norm_phone))).alias("contact")).filter("contact != ''").distinct(),
       f"WITH c AS (SELECT extract_id, lower(trim(unnest(email))) AS contact FROM extracted WHERE extract_id IS NOT NULL UNION SELECT extract_id, {_phone('p')} FROM (SELECT extract_id, unnest(phone) AS p FROM extracted WHERE extract_id IS NOT NULL)) SELECT DISTINCT extract_id, contact FROM c WHERE contact <> ''")
_query("cell_safe_text", lambda s, d: places(s, d).select("place_key", X.cell_safe(F.col("title")).alias("title"), X.cell_safe(F.col("phonenumber")).alias("phone")),
       f"WITH {_PLACES}, t AS (SELECT place_key, {_clean('title')} AS a, {_clean('phonenumber')} AS b FROM pl) SELECT place_key, left(CASE WHEN regexp_matches(a, '^[=+@]') THEN ' ' || a ELSE a END, 32000) AS title, left(CASE WHEN regexp_matches(b, '^[=+@]') THEN ' ' || b ELSE b END, 32000) AS phone FROM t")
_TITLE = C.TITLE_SPLIT.replace("\\s", r"[\t\n\f\r ]")
_query("page_titles", lambda s, d: places(s, d).select("place_key", X.clean_title(F.col("title")).alias("headline")),
       f"WITH {_PLACES}, t AS (SELECT place_key, list_filter(list_transform(string_split_regex({_clean('title')}, '{_TITLE}'), lambda p: trim(p, '{C.TITLE_EDGE}')), lambda p: length(p) >= 2 AND lower(p) NOT IN ({', '.join(repr(x) for x in C.TITLE_PARTS)})) AS parts FROM pl) SELECT place_key, left(coalesce(parts[1], ''), 120) AS headline FROM t")
_BARE = lambda col: f"trim(regexp_replace({col}, '{C.POSTCODE}', '', 'g'), ' ')"
_KEPT = "CASE WHEN {0} <> '' AND NOT regexp_matches({0}, '[0-9]') AND length({0}) <= 40 THEN {0} ELSE '' END"
_query("split_addresses", lambda s, d: places(s, d).select("place_key", X.split_address(F.col("address"), F.lit("")).alias("a")).select("place_key", "a.city", "a.state", "a.country"),
       f"WITH {_PLACES}, p AS (SELECT place_key, list_filter(list_transform(string_split(coalesce(address, ''), ','), lambda x: {_clean('x')}), lambda x: x <> '') AS parts FROM pl), "
       f"c AS (SELECT *, CASE WHEN lower(coalesce(parts[-1], '')) IN ({', '.join(repr(x) for x in C.COUNTRIES)}) THEN parts[-1] ELSE '' END AS country FROM p), r AS (SELECT *, CASE WHEN country <> '' THEN parts[:-2] ELSE parts END AS rest FROM c), "
       f"b AS (SELECT *, {_BARE("coalesce(rest[-1], '')")} AS st FROM r), s AS (SELECT *, {_KEPT.format('st')} AS state FROM b), l AS (SELECT *, CASE WHEN state <> '' THEN rest[:-2] ELSE rest END AS more FROM s), "
       f"d AS (SELECT *, {_BARE("coalesce(more[-1], '')")} AS ct FROM l) SELECT place_key, {_KEPT.format('ct')} AS city, state, country FROM d")
_query("document_emails", lambda s, d: table(s, d, "documents").select("doc_id", F.explode(X.find_emails(F.col("text"))).alias("email")),
       f"WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '{C.EMAIL}')) AS email FROM documents), t AS (SELECT DISTINCT doc_id, lower(regexp_replace(email, '^[.\\-_]+|[.\\-_]+$', '', 'g')) AS email FROM e) SELECT doc_id, email FROM t WHERE length(email) <= 80 AND NOT list_bool_or(list_transform([{', '.join(repr(x) for x in C.BAD_EMAIL_PARTS)}], lambda b: contains(email, b)))")
_query("document_phones", lambda s, d: table(s, d, "documents").select("doc_id", F.explode(X.find_phones(F.col("text"))).alias("phone")))
_query("valid_phones", lambda s, d: pages(s, d).select("extract_id", F.explode("phone").alias("phone")).distinct().select("extract_id", "phone", X.valid_phone(F.col("phone")).alias("valid")),
       "WITH p AS (SELECT DISTINCT extract_id, unnest(phone) AS phone FROM extracted WHERE extract_id IS NOT NULL), g AS (SELECT *, trim(coalesce(phone, '')) AS c, regexp_replace(coalesce(phone, ''), '\\D', '', 'g') AS g FROM p) "
       f"SELECT extract_id, phone, length(g) BETWEEN 8 AND 15 AND len(list_distinct(string_split(g, ''))) > 2 AND NOT regexp_matches(c, '{C.DATE_LIKE}') AND NOT regexp_matches(c, '{C.YEAR_RANGE}') AND g NOT IN ({', '.join(repr(x) for x in C.SEQUENTIAL_DIGITS)}) AS valid FROM g")
_query("query_keys", lambda s, d: log(s, d).select("seq", X.ledger_key(F.col("kind"), F.col("query"), F.col("page")).alias("key")), f"WITH {_KEYED} SELECT seq, {_LKEY} AS key FROM keyed")
_query("client_folders", lambda s, d: log(s, d).filter("client is not null").select("client").distinct().select("client", X.client_folder(F.col("client")).alias("folder")), "SELECT DISTINCT client, left(sha256(client), 32) AS folder FROM search_log WHERE client IS NOT NULL AND seq IS NOT NULL")
_query("slugs", lambda s, d: phrases.unique_slugs(requests(s, d), "custom_category", "request_id"),
       "WITH t AS (SELECT request_id, trim(regexp_replace(coalesce(custom_category, ''), '[\\s\\x{00A0}\\x{2003}]+', ' ', 'g')) AS n FROM collect_requests), f AS (SELECT arg_min(n, request_id) AS name, min(request_id) AS first_id FROM t WHERE n <> '' GROUP BY lower(n)), "
       "b AS (SELECT *, left(regexp_replace(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40) AS k FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN k = '' THEN 'Category' ELSE k END ORDER BY first_id, name) AS n FROM b) SELECT name, 'Custom_' || CASE WHEN k = '' THEN 'Category' ELSE k END || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS slug FROM r")

# rules
_REASON = ("CASE WHEN length(coalesce(title, '')) < 3 OR " + _name("title") + f" = '' THEN 'no plausible company name' WHEN regexp_matches(coalesce(title, ''), '{C.MEDIA_NAME}', 'i') OR regexp_matches(coalesce(title, ''), '{C.JUNK_NAME}', 'i') THEN 'name looks like publisher or article' "
           "WHEN coalesce(website, '') <> '' AND skip THEN 'website is a directory, social or media domain' WHEN coalesce(website, '') = '' AND coalesce(cid, '') = '' THEN 'no official website and not a listing' WHEN coalesce(phonenumber, '') = '' AND coalesce(address, '') = '' AND coalesce(website, '') = '' THEN 'no useful business attribute' ELSE '' END")
_VALID = f"h AS (SELECT *, {_host('website')} AS domain FROM pl), r AS (SELECT *, {_root('domain')} AS root FROM h), k AS (SELECT *, {_skip('root')} AS skip FROM r), valid AS (SELECT seq, count(*) AS valid FROM k WHERE seq IS NOT NULL AND {_REASON} = '' GROUP BY seq)"
_query("validation", lambda s, d: places(s, d).select("place_key", rules.rejection(F.col("title"), F.col("website"), F.lit(""), F.col("phonenumber"), F.col("address"), X.text(F.col("cid")) != "").alias("reason")),
       f"WITH {_PLACES}, h AS (SELECT *, {_host('website')} AS domain FROM pl), r AS (SELECT *, {_root('domain')} AS root FROM h), k AS (SELECT *, {_skip('root')} AS skip FROM r) SELECT place_key, {_REASON} AS reason FROM k")
_query("confidence", lambda s, d: places(s, d).select("place_key", rules.confidence(F.col("title"), F.col("website"), F.lit(""), F.col("phonenumber"), F.col("address"), rules.relevant(F.array(F.lit("tax"), F.lit("law")), F.col("title"))).alias("score")),
       f"WITH {_PLACES} SELECT place_key, least(100, (coalesce(website, '') <> '')::INT * 25 + (coalesce(phonenumber, '') <> '')::INT * 20 + (coalesce(address, '') <> '')::INT * 15 + (coalesce(title, '') <> '' AND coalesce(title, '') <> coalesce(website, '') AND contains(trim(coalesce(title, ''), ' '), ' '))::INT * 10 + (contains(lower(coalesce(title, '')), 'tax') OR contains(lower(coalesce(title, '')), 'law'))::INT * 10) AS score FROM pl")
_query("blocked_pages", lambda s, d: table(s, d, "documents").select("doc_id", rules.blocked_text(F.col("text")).alias("blocked")), "SELECT doc_id, regexp_matches(coalesce(text, ''), '(?im)" + rules.BLOCKED_LINE.replace("'", "''") + "') AS blocked FROM documents")

# reading results
_query("listings_by_request", lambda s, d: search.distinct_listings(places(s, d), ["seq"], "place_key").select("seq", "place_key"),
       f"WITH {_PLACES}, k AS (SELECT *, CASE WHEN coalesce(cid, '') <> '' THEN 'cid:' || cid WHEN coalesce(placeid, '') <> '' THEN 'placeid:' || placeid WHEN coalesce(title, '') <> '' THEN 'title:' || title ELSE '' END AS ident FROM pl) SELECT seq, min(place_key) AS place_key FROM k GROUP BY seq, ident")
_query("full_pages", lambda s, d: search.full_pages(log(s, d).filter("client is not null and results is not null").select("client", "seq", "results"), "client", "seq", "results").select("client", "seq"),
       f"WITH {_LOG}, w AS (SELECT client, seq, min(results) OVER (PARTITION BY client ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM log WHERE client IS NOT NULL AND results IS NOT NULL) SELECT client, seq FROM w WHERE least >= 10 OR least IS NULL")

# joins
_query("unknown_sites", lambda s, d: dedup.without_known(pages(s, d).select("extract_id", X.norm_domain(F.col("url")).alias("domain")), places(s, d).select(X.norm_domain(F.col("website")).alias("domain")).filter("domain != ''"), "domain"),
       f"WITH {_PLACES}, {_PAGES}, h AS (SELECT extract_id, {_host('url')} AS domain FROM pg) SELECT extract_id, domain FROM h WHERE domain NOT IN (SELECT {_host('website')} FROM pl WHERE {_host('website')} <> '')")
_query("request_sources", lambda s, d: ledger.request_source(log(s, d), "2025-12-01 00:00:00"),
       f"WITH {_KEYED}, l AS (SELECT {_LKEY} AS key, max(ts) AS last, sum(coalesce(credits, 0)) AS credits FROM keyed WHERE source = 'api' GROUP BY 1) SELECT key, CASE WHEN last > TIMESTAMP '2025-12-01 00:00:00' - INTERVAL 7 DAY THEN 'cache' WHEN last > TIMESTAMP '2025-12-01 00:00:00' - INTERVAL 30 DAY AND credits > 0 THEN 'executed' ELSE 'api' END AS source FROM l")
_query("attributed_listings", lambda s, d: log(s, d).select("seq", X.ledger_key(F.col("kind"), F.col("query"), F.col("page")).alias("key")).join(places(s, d).filter("seq is not null").groupBy("seq").agg(F.count("*").alias("n")), "seq").groupBy("key").agg(F.sum("n").alias("valid")),
       f"WITH {_KEYED}, {_PLACES}, p AS (SELECT seq, count(*) AS n FROM pl WHERE seq IS NOT NULL GROUP BY seq) SELECT {_LKEY} AS key, sum(n)::BIGINT AS valid FROM keyed JOIN p USING (seq) GROUP BY 1")
_query("places_with_pages", lambda s, d: places(s, d).select("place_key", X.norm_domain(F.col("website")).alias("domain")).filter("domain != ''").join(pages(s, d).groupBy(X.norm_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"), F.min("extract_id").alias("first_page")), "domain", "left").select("place_key", F.coalesce("pages", F.lit(0)).alias("pages"), "first_page"),
       f"WITH {_PLACES}, {_PAGES}, h AS (SELECT {_host('url')} AS domain, count(*) AS pages, min(extract_id) AS first_page FROM pg GROUP BY 1) SELECT place_key, coalesce(pages, 0) AS pages, first_page FROM (SELECT place_key, {_host('website')} AS domain FROM pl) p LEFT JOIN h USING (domain) WHERE domain <> ''")
_query("state_lookup", lambda s, d: table(s, d, "geo_list").filter("state is not null and city is null").select(F.lower("state").alias("state"), "country", "geo_id").join(table(s, d, "collect_requests").filter("trim(state) != ''").select("request_id", F.lower(F.trim("state")).alias("state")).distinct(), "state").groupBy("request_id").agg(F.min_by("country", "geo_id").alias("country")),
       "SELECT request_id, arg_min(country, geo_id) AS country FROM (SELECT DISTINCT request_id, lower(trim(state, ' ')) AS s FROM collect_requests WHERE trim(state, ' ') <> '') r JOIN geo_list g ON lower(g.state) = r.s AND g.city IS NULL GROUP BY request_id")
_query("file_diff", lambda s, d: summary.signature_diff(places(s, d).select("website", "phonenumber").filter("website is not null").groupBy("website").agg(F.max("phonenumber").alias("sign")), table(s, d, "partner_places").filter("website is not null").groupBy("website").agg(F.max("phonenumber").alias("sign")), "website", "sign"),
       f"WITH {_PLACES}, a AS (SELECT website, max(phonenumber) AS a FROM pl WHERE website IS NOT NULL GROUP BY 1), b AS (SELECT website, max(phonenumber) AS b FROM partner_places WHERE website IS NOT NULL GROUP BY 1) SELECT website, CASE WHEN a IS NULL THEN 'delete' ELSE 'upsert' END AS action FROM a FULL JOIN b USING (website) WHERE a IS NULL OR b IS NULL OR a <> b")

# aggregates
_query("ledger_entries", lambda s, d: ledger.entries(log(s, d)),
       f"WITH {_KEYED} SELECT {_LKEY} AS key, count(*) FILTER (WHERE source = 'api') AS requests, coalesce(sum(coalesce(credits, 0)) FILTER (WHERE source = 'api'), 0)::BIGINT AS credits, coalesce(sum(coalesce(results, 0)) FILTER (WHERE source = 'api'), 0)::BIGINT AS results, coalesce(sum(coalesce(new_results, 0)) FILTER (WHERE source = 'api'), 0)::BIGINT AS new_results, "
       "coalesce(sum(greatest(0, coalesce(results, 0) - coalesce(new_results, 0))) FILTER (WHERE source = 'api'), 0)::BIGINT AS duplicates, count(*) FILTER (WHERE source = 'cache') AS cache_hits, sum(coalesce(timeouts, 0))::BIGINT AS timeouts, (max({'ts': ts, 'seq': seq}) FILTER (WHERE source = 'api')).seq AS last_seq FROM keyed GROUP BY 1")
_query("ledger_totals", lambda s, d: ledger.totals(log(s, d), valid(s, d)),
       f"WITH {_LOG}, {_PLACES}, {_VALID}, t AS (SELECT CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, count(*) AS requests, sum(credits)::BIGINT AS credits, sum(results)::BIGINT AS results, sum(new_results)::BIGINT AS new_results, sum(coalesce(valid, 0))::BIGINT AS valid FROM log LEFT JOIN valid USING (seq) WHERE source = 'api' AND kind IS NOT NULL GROUP BY ROLLUP (kind)) "
       "SELECT *, results - new_results AS duplicates, round(new_results / nullif(credits, 0), 2) AS new_per_credit, round(valid / nullif(credits, 0), 2) AS valid_per_credit, round(credits / nullif(valid, 0), 3) AS credits_per_valid, round(100.0 * (results - new_results) / nullif(results, 0), 1) AS repeat_percent FROM t")
for _name_, _best_, _dir_ in (("best_queries", True, "DESC"), ("worst_queries", False, "ASC")):
    _query(_name_, lambda s, d, b=_best_: ledger.ranked_queries(log(s, d), valid(s, d), 10, b),
           f"WITH {_KEYED}, {_PLACES}, {_VALID}, q AS (SELECT {_LKEY} AS key, sum(coalesce(credits, 0))::BIGINT AS credits, sum(coalesce(results, 0))::BIGINT AS results, sum(coalesce(new_results, 0))::BIGINT AS new_results, sum(coalesce(valid, 0))::BIGINT AS valid, min(seq) AS first_seq FROM keyed LEFT JOIN valid USING (seq) WHERE source = 'api' AND query IS NOT NULL GROUP BY 1) "
           f"SELECT *, round(valid / credits, 2) AS valid_per_credit, round(100 * ((results - new_results) / nullif(results, 0)), 1) AS duplicate_percent FROM q WHERE credits > 0 ORDER BY valid / credits {_dir_}, new_results {_dir_}, first_seq {'ASC' if _best_ else 'DESC'} LIMIT 10")
_SEEN = "SELECT category, count(*) AS discovered, count(*) FILTER (WHERE status = 'duplicate') AS duplicates, count(*) FILTER (WHERE status <> 'ok') AS failed_urls FROM log GROUP BY category"


def _contactable(spark: SparkSession, sf: str) -> DataFrame:
    """Listings with the smallest e-mail address of their site's pages."""
    mail = pages(spark, sf).select(X.norm_domain(F.col("url")).alias("domain"), F.explode("email").alias("email")).filter("email is not null").groupBy("domain").agg(F.min("email").alias("email"))
    return places(spark, sf).withColumn("domain", X.norm_domain(F.col("website"))).join(mail, "domain", "left")


def _seen(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).groupBy("category").agg(F.count("*").alias("discovered"), F.count_if(F.col("status") == "duplicate").alias("duplicates"), F.count_if(F.col("status") != "ok").alias("failed_urls"))


_MAILED = f"mail AS (SELECT domain, min(e) AS email FROM (SELECT {_host('url')} AS domain, unnest(email) AS e FROM extracted WHERE extract_id IS NOT NULL) GROUP BY 1), pm AS (SELECT pl.*, mail.email FROM pl LEFT JOIN mail ON mail.domain = {_host('website')})"
_FILLED = "count(*) FILTER (WHERE coalesce(email, '') <> '') AS emails, count(*) FILTER (WHERE coalesce(website, '') <> '') AS websites, count(*) FILTER (WHERE coalesce(phonenumber, '') <> '') AS phones, count(*) FILTER (WHERE coalesce(address, '') <> '') AS addresses"
_query("category_stats", lambda s, d: summary.category_stats(_contactable(s, d)), f"WITH {_PLACES}, {_MAILED} SELECT category, count(*) AS records, {_FILLED} FROM pm GROUP BY category")
_query("category_summary", lambda s, d: summary.summary_with_total(_contactable(s, d), _seen(s, d)),
       f"WITH {_PLACES}, {_LOG}, {_MAILED}, c AS (SELECT coalesce(category, '') AS category, count(*) AS records, {_FILLED} FROM pm GROUP BY 1), f AS (SELECT coalesce(category, '') AS category, discovered, duplicates, failed_urls FROM ({_SEEN})), "
       "e AS (SELECT category, coalesce(discovered, records, 0) AS found, coalesce(records, 0) AS records, coalesce(websites, 0) AS websites, coalesce(emails, 0) AS emails, coalesce(phones, 0) AS phones, coalesce(addresses, 0) AS addresses, coalesce(duplicates, 0) AS duplicates, coalesce(failed_urls, 0) AS failed_urls FROM c FULL JOIN f USING (category)) "
       "SELECT CASE WHEN grouping(category) = 1 THEN 'TOTAL' ELSE category END AS category, " + ", ".join(f"sum({m})::BIGINT AS {m}" for m in "found records websites emails phones addresses duplicates failed_urls".split()) + " FROM e GROUP BY ROLLUP (category)")
_query("key_figures", lambda s, d: summary.key_figures(_contactable(s, d).withColumn("services", F.col("category")), log(s, d), 1000),
       f"WITH {_KEYED}, {_PLACES}, {_MAILED}, m AS (SELECT count(*) AS records, 1000 AS target, (count(*) >= 1000)::INT AS target_reached, round(count(*) / 10.0, 2) AS completion_percent, count(DISTINCT category) AS categories, count(*) FILTER (WHERE coalesce(email, '') <> '') AS with_email, count(*) FILTER (WHERE coalesce(phonenumber, '') <> '') AS with_phonenumber, count(*) FILTER (WHERE coalesce(address, '') <> '') AS with_address, count(*) FILTER (WHERE coalesce(category, '') <> '') AS with_services, "
       f"count(DISTINCT {_host('website')}) AS domains FROM pm), n AS (SELECT count(DISTINCT phrase || '@' || place) AS queries, count(*) AS searches, coalesce(sum(credits), 0) AS credits FROM keyed) "
       "SELECT metric, value::DOUBLE AS value FROM (UNPIVOT (SELECT " + ", ".join(f"{c}::DOUBLE AS {c}" for c in "records target target_reached completion_percent categories with_email with_phonenumber with_address with_services domains queries searches credits".split()) + " FROM m, n) ON COLUMNS(*) INTO NAME metric VALUE value)")
_query("category_shares", lambda s, d: summary.share_of_total(places(s, d)), f"WITH {_PLACES} SELECT coalesce(category, '') AS category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM pl GROUP BY 1")
_query("record_audit", lambda s, d: summary.audit(places(s, d)), f"WITH {_PLACES}, x AS (SELECT {_host('website')} AS dm, {_name('title')} AS nm FROM pl) SELECT count(*) AS records, count(*) FILTER (WHERE dm <> '') - count(DISTINCT dm) FILTER (WHERE dm <> '') AS duplicate_domains, count(*) FILTER (WHERE nm <> '') - count(DISTINCT nm) FILTER (WHERE nm <> '') AS duplicate_names, count(DISTINCT dm) AS domains FROM x")
_query("state_request_counts", lambda s, d: summary.dimension_counts(table(s, d, "geo_list").filter("state is not null and city is null").select("geo_id", F.col("state")), table(s, d, "collect_requests").select("request_id", "state").distinct(), "state").select("geo_id", "n"),
       "SELECT g.geo_id, count(r.request_id) AS n FROM geo_list g LEFT JOIN (SELECT DISTINCT request_id, state FROM collect_requests) r ON r.state = g.state WHERE g.state IS NOT NULL AND g.city IS NULL GROUP BY g.geo_id")
_query("results_percentiles", lambda s, d: ledger.positional_percentile(log(s, d).filter("client is not null"), "client", "results", 0.95).withColumnRenamed("at", "p95"),
       f"WITH {_LOG} SELECT client, count(*) AS n, list_sort(list(results))[(floor(0.95 * (count(*) - 1)) + 1)::INT] AS p95 FROM log WHERE client IS NOT NULL AND results IS NOT NULL GROUP BY client")
_query("rolling_credits", lambda s, d: ledger.rolling_credits(log(s, d)),
       f"WITH {_LOG} SELECT seq, client, sum(coalesce(credits, 0)) OVER (PARTITION BY client ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)::BIGINT AS spent FROM (SELECT *, date_trunc('second', ts) AS t2 FROM log) WHERE source = 'api' AND client IS NOT NULL".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"))
_RATED = "rt AS (SELECT phrase, place, seq, kind, coalesce(page, 1) AS page, coalesce(credits, 0) AS credits, results, new_results FROM keyed WHERE source = 'api' AND query IS NOT NULL)"
_FRESH = "b AS (SELECT place, coalesce(new_results / nullif(results, 0), 0.0) AS v, row_number() OVER (PARTITION BY place ORDER BY seq DESC) - 1 AS back, count(*) OVER (PARTITION BY place) AS n FROM rt WHERE results IS NOT NULL), fr AS (SELECT place, 0.75 * sum(CASE WHEN back = n - 1 THEN v * pow(0.5, n - 1) ELSE v * pow(0.5, back + 1) END) AS freshness FROM b GROUP BY place)"
_QUALITY = "ph AS (SELECT phrase, sum(credits) AS credits, sum(coalesce(results, 0)) AS results, sum(coalesce(new_results, 0)) AS new_results, sum(coalesce(valid, 0)) AS valid FROM rt LEFT JOIN valid USING (seq) GROUP BY phrase), ql AS (SELECT *, (new_results + 2.1) / (results + 3) * CASE WHEN credits >= 3 AND (SELECT sum(valid) / sum(credits) FROM ph) > 0 THEN least(1.0, greatest(0.3, (valid / credits) / (SELECT sum(valid) / sum(credits) FROM ph))) ELSE 1.0 END AS quality FROM ph)"
_FOLLOW = "pr AS (SELECT kind, phrase, place, page + 1 AS page, arg_max(coalesce(new_results / nullif(results, 0), 0.0), seq) AS parent_rate FROM rt WHERE results IS NOT NULL GROUP BY ALL), le AS (SELECT coalesce(sum(parent_rate * results), 0) AS expected_new, coalesce(sum(new_results), 0) AS got, count(*) AS measured FROM rt JOIN pr USING (kind, phrase, place, page) WHERE page > 1 AND results IS NOT NULL AND credits > 0), lr AS (SELECT *, (got + 7.0) / (expected_new + 20.0) AS ratio FROM le)"
_PLAN = f"WITH {_KEYED}, {_PLACES}, {_VALID}, {_RATED}"
_query("place_averages", lambda s, d: planner.place_freshness(log(s, d)).select("place", F.floor(F.col("freshness") * 1000 + 0.51).alias("freshness")),
       f"{_PLAN}, {_FRESH} SELECT place, floor(1000 * freshness + 0.51)::BIGINT AS freshness FROM fr")
_query("planner_cells", lambda s, d: planner.cells(log(s, d)),
       f"WITH {_KEYED} SELECT phrase, place, sum(coalesce(credits, 0))::BIGINT AS credits, sum(results)::BIGINT AS results, sum(new_results)::BIGINT AS new_results, max(page) AS last_page, arg_max(results, {{'page': page, 'seq': seq}}) AS last_size FROM keyed WHERE source = 'api' AND query IS NOT NULL GROUP BY phrase, place")
_query("phrase_quality", lambda s, d: planner.phrase_quality(log(s, d), valid(s, d)).withColumn("quality", F.round("quality", 6)), f"{_PLAN}, {_QUALITY} SELECT phrase, round(quality, 6) AS quality, credits::BIGINT AS credits, results::BIGINT AS results, new_results::BIGINT AS new_results, valid::BIGINT AS valid FROM ql")
_query("next_cells", lambda s, d: planner.next_cells(log(s, d), 20, valid(s, d), table(s, d, "geo_list").filter("city is not null").select(X.canon_place(F.concat_ws(", ", "city", "state")).alias("place"))),
       f"{_PLAN}, {_QUALITY}, {_FRESH}, g AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(concat_ws(', ', city, state)), '[a-z0-9]+'), ' ') AS place FROM geo_list WHERE city IS NOT NULL), a AS (SELECT place, round(freshness, 6) AS freshness FROM fr UNION ALL SELECT place, 0.9::DOUBLE FROM g WHERE place NOT IN (SELECT place FROM fr)), "
       "c AS (SELECT phrase, place, round(quality, 6) * freshness AS expected FROM ql, a WHERE round(quality, 6) * freshness > 0.06) SELECT phrase, place, round(expected, 6) AS expected FROM c ANTI JOIN rt USING (phrase, place) ORDER BY c.expected DESC, phrase, place LIMIT 20")
_query("follow_up_pages", lambda s, d: planner.follow_ups(log(s, d)).withColumn("expected", F.round("expected", 6)),
       f"{_PLAN}, {_FOLLOW}, g AS (SELECT phrase, place, page + 1 AS page, arg_max(seq, seq) AS seq, arg_max(new_results / results, seq) AS rate FROM rt WHERE kind = 'places' AND page < 3 AND results >= 8 AND new_results / results >= 0.5 GROUP BY ALL) SELECT seq, page, round(rate * (SELECT ratio FROM lr), 6) AS expected FROM g ANTI JOIN (SELECT phrase, place, page FROM rt WHERE kind = 'places') t USING (phrase, place, page)")
_query("follow_up_learning", lambda s, d: planner.follow_up_learning(log(s, d)).select(F.round("expected_new", 4).alias("expected_new"), "new_results", "measured", F.round("ratio", 6).alias("ratio")), f"{_PLAN}, {_FOLLOW} SELECT round(expected_new, 4) AS expected_new, got::BIGINT AS new_results, measured, round(ratio, 6) AS ratio FROM lr")
_query("thin_cells", lambda s, d: planner.thin_cells(log(s, d), valid(s, d)).withColumn("expected", F.round("expected", 6)),
       f"{_PLAN}, {_QUALITY} SELECT DISTINCT phrase, place, round(quality * 0.72, 6) AS expected FROM (SELECT phrase, place FROM rt WHERE kind = 'places' AND page = 1 AND results < 5 AND credits > 0) t ANTI JOIN (SELECT phrase, place FROM rt WHERE kind = 'organic') o USING (phrase, place) JOIN ql USING (phrase)")
_query("deep_requests", lambda s, d: planner.deep_requests(log(s, d), 50),
       f"{_PLAN}, c AS (SELECT phrase, place, sum(coalesce(new_results, 0))::BIGINT AS new_results, min(seq) AS first_seq, arg_max(page, {{'p': page, 's': seq}}) FILTER (WHERE kind = 'places') AS pp, arg_max(results, {{'p': page, 's': seq}}) FILTER (WHERE kind = 'places') AS pn, arg_max(page, {{'p': page, 's': seq}}) FILTER (WHERE kind = 'organic') AS op, arg_max(results, {{'p': page, 's': seq}}) FILTER (WHERE kind = 'organic') AS opn FROM rt GROUP BY phrase, place), "
       "n AS (SELECT *, CASE WHEN pp IS NULL THEN 'places' WHEN pp < 5 AND pn >= 8 THEN 'places' WHEN op IS NULL THEN 'organic' WHEN op < 3 AND opn >= 8 THEN 'organic' END AS kind, CASE WHEN pp IS NULL THEN 1 WHEN pp < 5 AND pn >= 8 THEN pp + 1 WHEN op IS NULL THEN 1 WHEN op < 3 AND opn >= 8 THEN op + 1 END::BIGINT AS page FROM c WHERE new_results > 0) SELECT phrase, place, kind, page, new_results FROM n WHERE kind IS NOT NULL ORDER BY new_results DESC, first_seq LIMIT 50")
_query("kind_efficiency", lambda s, d: planner.kind_efficiency(log(s, d), valid(s, d)), f"{_PLAN}, e AS (SELECT kind, sum(credits)::BIGINT AS credits, sum(coalesce(valid, 0))::BIGINT AS valid FROM rt LEFT JOIN valid USING (seq) WHERE kind IS NOT NULL GROUP BY kind) SELECT *, round(valid / nullif(credits, 0), 2) AS valid_per_credit FROM e")
_query("top_phrases", lambda s, d: planner.top_phrases(log(s, d), valid(s, d)), f"{_PLAN}, {_QUALITY} SELECT phrase, credits::BIGINT AS credits, results::BIGINT AS results, new_results::BIGINT AS new_results, valid::BIGINT AS valid, round(valid / nullif(credits, 0), 2) AS valid_per_credit FROM ql ORDER BY new_results DESC, phrase LIMIT 5")
_query("planner_summary", lambda s, d: planner.planner_summary(log(s, d), valid(s, d)),
       f"{_PLAN}, {_FOLLOW}, t AS (SELECT count(*) AS n FROM (SELECT DISTINCT phrase, place FROM rt WHERE kind = 'places' AND page = 1 AND results < 5 AND credits > 0) t ANTI JOIN (SELECT phrase, place FROM rt WHERE kind = 'organic') o USING (phrase, place)), v AS (SELECT coalesce(sum(valid), 0)::BIGINT AS valid FROM rt JOIN valid USING (seq)) "
       "SELECT count(DISTINCT phrase) AS phrases, count(DISTINCT place) AS places, count(DISTINCT phrase || '@' || place) AS cells, count(*) FILTER (WHERE page > 1) AS follow_ups, sum(credits)::BIGINT AS credits, (SELECT valid FROM v) AS valid, (SELECT n FROM t) AS thin_cells, (SELECT round(ratio, 3) FROM lr) AS follow_up_ratio, round((SELECT valid FROM v) / nullif(sum(credits), 0), 2) AS valid_per_credit FROM rt")


def _running(spark: SparkSession, sf: str) -> DataFrame:
    """A job runs as long as the last search of its client and category did not succeed."""
    last = log(spark, sf).filter("client is not null and category is not null").groupBy("client", "category").agg(F.max_by(F.coalesce("status", F.lit("")), "seq").alias("status"))
    return last.filter("status != 'ok'").select("client", "category")


_query("run_metrics", lambda s, d: ledger.run_metrics(log(s, d)),
       f"WITH {_LOG}, m AS (SELECT client, count(*) AS requests, count(*) FILTER (WHERE source = 'api') AS paid, count(*) FILTER (WHERE source = 'cache') AS cached, count(*) FILTER (WHERE source = 'executed') AS skipped, coalesce(sum(credits) FILTER (WHERE source = 'api'), 0)::BIGINT AS credits, sum(coalesce(new_results, 0))::BIGINT AS new_results, sum(coalesce(timeouts, 0))::BIGINT AS timeouts, count(*) FILTER (WHERE status <> 'ok') AS failed FROM log WHERE client IS NOT NULL GROUP BY client) SELECT *, round(new_results / nullif(credits, 0), 2) AS new_per_credit FROM m")
_query("startable_jobs", lambda s, d: ledger.startable(table(s, d, "collect_requests").filter("client is not null and category is not null and ts is not null").select(F.col("request_id").alias("seq"), "client", "category").distinct(), _running(s, d), 10_000),
       f"WITH {_LOG}, busy AS (SELECT client, category FROM log WHERE client IS NOT NULL AND category IS NOT NULL GROUP BY ALL HAVING arg_max(coalesce(status, ''), seq) <> 'ok'), f AS (SELECT client, category, min(request_id) AS seq FROM collect_requests q WHERE client IS NOT NULL AND category IS NOT NULL AND ts IS NOT NULL AND NOT EXISTS (SELECT 1 FROM busy b WHERE b.client = q.client AND b.category = q.category) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM f) SELECT seq, client, category FROM r WHERE n <= greatest(0, 10000 - (SELECT count(*) FROM busy))")
_query("fair_categories", lambda s, d: ledger.fairness(log(s, d)), f"WITH {_LOG}, n AS (SELECT category, count(*) AS rounds FROM log WHERE category IS NOT NULL GROUP BY category) SELECT category, rounds, rounds - min(rounds) OVER () > 2 AS wait FROM n")
_query("search_places", lambda s, d: planner.expand_all_places(table(s, d, "geo_list")),
       "WITH c AS (SELECT country, city || coalesce(', ' || state, '') AS place, row_number() OVER (PARTITION BY country, state ORDER BY geo_id) AS depth, geo_id FROM geo_list WHERE country IS NOT NULL AND city IS NOT NULL), f AS (SELECT country, place, unnest(arg_min({'d': depth, 'g': geo_id}, {'d': depth, 'g': geo_id})) FROM c GROUP BY country, place UNION ALL SELECT DISTINCT country, country, 0, -1 FROM geo_list WHERE country IS NOT NULL) SELECT country, (row_number() OVER (PARTITION BY country ORDER BY d, g))::INT AS rank, place FROM f")
_query("rate_limited", lambda s, d: folds.rate_limited(log(s, d).filter("client is not null and ts is not null").select("client", "seq", F.col("ts").cast("timestamp").cast("double").alias("at")), 3, 3600).select("seq", "allowed"),
       f"WITH RECURSIVE {_LOG}, o AS (SELECT client, seq, epoch_us(ts) / 1000000.0 AS tm, row_number() OVER (PARTITION BY client ORDER BY ts, seq) AS i FROM log WHERE client IS NOT NULL AND ts IS NOT NULL), "
       "f AS (SELECT client, 0::BIGINT AS i, 0::BIGINT AS seq, -2::BIGINT AS bucket, 0 AS before, 0 AS now, false AS allowed FROM o GROUP BY client UNION ALL SELECT client, i, seq, bucket, before, now + (before * (1 - part) + now < 3)::INT, before * (1 - part) + now < 3 FROM "
       "(SELECT o.client, o.i, o.seq, floor(tm / 3600)::BIGINT AS bucket, CASE WHEN floor(tm / 3600)::BIGINT = f.bucket THEN f.before WHEN floor(tm / 3600)::BIGINT = f.bucket + 1 THEN f.now ELSE 0 END AS before, CASE WHEN floor(tm / 3600)::BIGINT = f.bucket THEN f.now ELSE 0 END AS now, tm / 3600 - floor(tm / 3600) AS part FROM f JOIN o ON o.client = f.client AND o.i = f.i + 1)) SELECT seq, allowed FROM f WHERE i > 0")
_query("adaptive_rates", lambda s, d: folds.adaptive_rate(log(s, d).filter("source is not null").select("source", "seq", F.coalesce("status", F.lit("")).alias("status"))).select("seq", F.round("rate", 6).alias("rate")),
       f"WITH RECURSIVE {_LOG}, o AS (SELECT source, seq, coalesce(status, '') = 'ok' AS good, row_number() OVER (PARTITION BY source ORDER BY seq) AS i FROM log WHERE source IS NOT NULL), f AS (SELECT source, 0::BIGINT AS i, 0::BIGINT AS seq, 0 AS ok, 8.0::DOUBLE AS rate FROM o GROUP BY source UNION ALL "
       "SELECT o.source, o.i, o.seq, CASE WHEN NOT good THEN 0 WHEN f.ok + 1 >= 10 AND f.rate < 8 THEN 0 ELSE f.ok + 1 END, CASE WHEN NOT good THEN greatest(1.0, f.rate * 0.7::DOUBLE) WHEN f.ok + 1 >= 10 AND f.rate < 8 THEN least(8.0, f.rate + 0.5::DOUBLE) ELSE f.rate END FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1) SELECT seq, round(rate, 6) AS rate FROM f WHERE i > 0")

# windows, ranks, sets
_query("failure_streaks", lambda s, d: ledger.failure_streaks(log(s, d)),
       f"WITH {_LOG}, o AS (SELECT *, CASE WHEN status = 'ok' THEN 1 ELSE 0 END AS ok FROM log WHERE client IS NOT NULL), i AS (SELECT *, sum(ok) OVER (PARTITION BY client ORDER BY seq) AS island FROM o), k AS (SELECT seq, sum(1 - ok) OVER (PARTITION BY client, island ORDER BY seq)::BIGINT AS streak FROM i) SELECT seq, streak, CASE WHEN streak >= 3 THEN least(30.0, 2 * pow(2.0, least(8, floor((streak - 3) / 2)))) ELSE 0.0 END::DOUBLE AS pause FROM k")
_query("stalls", lambda s, d: ledger.stalls(log(s, d)), f"WITH {_LOG}, g AS (SELECT seq, floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY client ORDER BY ts, seq) AS idle FROM log WHERE client IS NOT NULL AND ts IS NOT NULL) SELECT seq, idle FROM g WHERE idle > 300")
_query("dry_spells", lambda s, d: ledger.dry_spells(log(s, d), 2, 2), f"WITH {_LOG}, g AS (SELECT seq, sum(coalesce(new_results, 0)) OVER w AS s, count(*) OVER w AS n FROM log WHERE client IS NOT NULL WINDOW w AS (PARTITION BY client ORDER BY seq ROWS 1 PRECEDING)) SELECT seq FROM g WHERE s = 0 AND n >= 2")
_query("last_requests", lambda s, d: ledger.last_rows(log(s, d).filter("client is not null"), "client", "seq", 5).select("client", "seq", "rank", "total"), f"WITH {_LOG}, r AS (SELECT client, seq, row_number() OVER (PARTITION BY client ORDER BY seq DESC) AS rank, count(*) OVER (PARTITION BY client) AS total FROM log WHERE client IS NOT NULL) SELECT * FROM r WHERE rank <= 5")
_query("rate_pressure", lambda s, d: ledger.rate_pressure(log(s, d), 3600),
       f"WITH {_LOG}, m AS (SELECT client, floor(floor(epoch(ts)) / 3600)::BIGINT AS minute, count(*) AS hits FROM log WHERE client IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2) SELECT client, minute, hits, hits + CASE WHEN minute - lag(minute) OVER w = 1 THEN lag(hits) OVER w * 0.5 ELSE 0.0 END::DOUBLE AS pressure FROM m WINDOW w AS (PARTITION BY client ORDER BY minute)")
_query("evicted_log", lambda s, d: ledger.evict_oldest(log(s, d).filter("ts is not null").select("ts", "seq"), ["ts", "seq"], 500, 4).select("seq"), f"WITH {_LOG}, r AS (SELECT seq, row_number() OVER (ORDER BY ts, seq) AS rank, count(*) OVER () AS n FROM log WHERE ts IS NOT NULL) SELECT seq FROM r WHERE n <= 500 OR rank > n // 4")
_query("target_cap", lambda s, d: dedup.up_to_target(places(s, d).filter("category is not null").select("category", "place_key"), ["category"], "place_key", 25), f"WITH {_PLACES}, r AS (SELECT category, place_key, row_number() OVER (PARTITION BY category ORDER BY place_key) AS n FROM pl WHERE category IS NOT NULL) SELECT category, place_key FROM r WHERE n <= 25")
_query("ordered_union", lambda s, d: summary.ordered_union([places(s, d).filter("category is not null").select("category", F.lit("places").alias("source")).distinct(), table(s, d, "collect_requests").filter("category is not null").select("category", F.lit("requests").alias("source")).distinct()], "category").select(F.lower("category").alias("category"), "source"),
       f"WITH {_PLACES}, u AS (SELECT lower(category) AS category, 0 AS p FROM pl WHERE category IS NOT NULL UNION ALL SELECT lower(category), 1 FROM collect_requests WHERE category IS NOT NULL) SELECT category, CASE WHEN min(p) = 0 THEN 'places' ELSE 'requests' END AS source FROM u GROUP BY category")
_query("access_stats", lambda s, d: ledger.access_stats(table(s, d, "events"), "event_type", "value", F.col("value") < 0, F.col("value") > 100, F.date_trunc("minute", "ts")),
       "WITH v AS (SELECT event_type, date_trunc('minute', ts) AS minute, count(*) AS n, count(*) FILTER (WHERE value < 0) AS errors, count(*) FILTER (WHERE value > 100) AS throttled, list_sort(list(value) FILTER (WHERE value IS NOT NULL)) AS xs FROM events GROUP BY 1, 2) SELECT event_type, minute, n, errors, throttled, xs[len(xs) // 2 + 1] AS p50, xs[floor(len(xs) * 0.95)::INT + 1] AS p95 FROM v")
_query("run_rates", lambda s, d: ledger.run_rates(log(s, d)),
       f"WITH {_LOG}, x AS (SELECT client, count(*) AS requests, sum(coalesce(results, 0))::BIGINT AS results, sum(coalesce(new_results, 0))::BIGINT AS new_results, count(*) FILTER (WHERE status = 'ok') AS ok, greatest(epoch_us(max(ts)) / 1000000.0 - epoch_us(min(ts)) / 1000000.0, 0.001) / 60 AS m FROM log WHERE client IS NOT NULL AND ts IS NOT NULL GROUP BY client) SELECT client, requests, new_results, round(requests / m, 1) AS requests_per_minute, round(new_results / m, 1) AS new_results_per_minute, round(1 - new_results / nullif(results, 0), 3) AS repeat_share, round(ok / requests, 3) AS success_share FROM x")
_query("restarts", lambda s, d: ledger.restarts_allowed(log(s, d).filter("client is not null and ts is not null and status != 'ok'").select("seq", "client", "ts"), "client", "ts", 5, 86_400).select("seq", "recent", "allowed"),
       f"WITH {_LOG}, r AS (SELECT seq, count(*) OVER (PARTITION BY client ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent FROM log WHERE client IS NOT NULL AND ts IS NOT NULL AND status <> 'ok') SELECT *, recent <= 5 AS allowed FROM r")
_query("log_since", lambda s, d: ledger.since(log(s, d), 10).select("seq", "reset"), f"WITH {_LOG}, m AS (SELECT max(seq) AS newest FROM log) SELECT seq, 10 < newest - 300 AS reset FROM log, m WHERE seq > newest - 300 AND (10 < newest - 300 OR seq > 10)")
_query("slowest_requests", lambda s, d: ledger.slowest(log(s, d), "timeouts", "seq").select("seq", "timeouts"), f"WITH {_LOG} SELECT seq, timeouts FROM log WHERE timeouts IS NOT NULL ORDER BY timeouts DESC, seq LIMIT 10")
_query("stage_timings", lambda s, d: ledger.timings(log(s, d), "status", "results"), f"WITH {_LOG} SELECT status, count(results) AS count, sum(results)::BIGINT AS total, avg(results) AS average FROM log WHERE status IS NOT NULL GROUP BY status")
_query("latest_listings", lambda s, d: dedup.last_wins(table(s, d, "partner_places").filter("title is not null").select("title", "listing_id", "updated_at"), ["title"], ["updated_at", "listing_id"]).select("title", "listing_id"),
       "WITH p AS (SELECT DISTINCT title, listing_id, updated_at FROM partner_places WHERE title IS NOT NULL) SELECT title, arg_max(listing_id, {'u': coalesce(updated_at, TIMESTAMP '0001-01-01'), 'l': listing_id}) AS listing_id FROM p GROUP BY title")
_query("purged_entries", lambda s, d: dedup.purged(ledger.entries(log(s, d)), "key", "places").select("key"), f"WITH {_KEYED} SELECT DISTINCT {_LKEY} AS key FROM keyed WHERE NOT starts_with({_LKEY}, 'places|')")
_query("access_minutes", lambda s, d: table(s, d, "events").groupBy(F.date_trunc("minute", "ts").alias("minute"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 0).alias("negative")), "SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n, count(*) FILTER (WHERE value < 0) AS negative FROM events GROUP BY 1, 2")

# phrases and places of requests
_REQ = "rq AS (SELECT DISTINCT ON (request_id) *, list_filter(list_transform(string_split(coalesce(keywords, ''), ','), lambda k: trim(k, ' ')), lambda k: k <> '') AS keys, coalesce(CASE WHEN trim(custom_category, ' ') <> '' THEN custom_category END, category, '') AS named FROM collect_requests WHERE request_id IS NOT NULL)"
_GENERIC = ", ".join(repr(w) for w in C.GENERIC_WORDS)
_TIDY = "trim(regexp_replace({0}, '[\\s\\x{{00A0}}\\x{{2003}}]+', ' ', 'g'), ' ')"
_query("search_phrases", lambda s, d: requests(s, d).select("request_id", F.posexplode(phrases.search_phrases(F.col("named"), F.col("keys"))).alias("pos", "phrase")).select("request_id", (F.col("pos") + 1).alias("rank"), "phrase"),
       f"WITH {_REQ}, t AS (SELECT *, {_TIDY.format('named')} AS nm FROM rq), c AS (SELECT *, array_to_string(list_filter(string_split(nm, ' '), lambda w: lower(w) NOT IN ({_GENERIC})), ' ') AS c0 FROM t), e AS (SELECT request_id, list_concat(list_transform(keys, lambda k: {_TIDY.format('k')}), [nm, CASE WHEN c0 <> '' THEN c0 ELSE nm END || ' companies', CASE WHEN c0 <> '' THEN c0 ELSE nm END || ' services']) AS ps FROM c), "
       "x AS (SELECT request_id, unnest(ps) AS phrase, generate_subscripts(ps, 1) AS i FROM e), f AS (SELECT request_id, arg_min(trim(phrase, ' '), i) AS phrase, min(i) AS i FROM x WHERE trim(phrase, ' ') <> '' GROUP BY request_id, lower(trim(phrase, ' '))) SELECT request_id, (row_number() OVER (PARTITION BY request_id ORDER BY i))::INT AS rank, phrase FROM f")
_query("relevance_terms", lambda s, d: requests(s, d).select("request_id", F.explode(phrases.custom_terms(F.col("named"), F.col("keys"))).alias("term")),
       f"WITH {_REQ}, w AS (SELECT request_id, lower(named) AS term FROM rq UNION SELECT request_id, w FROM (SELECT request_id, unnest(string_split_regex(lower(one), '[^A-Za-z0-9+#]+')) AS w FROM (SELECT request_id, unnest(list_concat([named], keys)) AS one FROM rq)) WHERE length(w) >= 2 AND w NOT IN ({_GENERIC})) SELECT DISTINCT request_id, term FROM w")
_query("request_states", lambda s, d: phrases.resolved_states(requests(s, d), table(s, d, "geo_list")),
       f"WITH {_REQ}, g AS (SELECT DISTINCT geo_id, country, country_code, state, unnest([lower(state), lower(coalesce(state_code, state))]) AS key FROM geo_list WHERE state IS NOT NULL AND city IS NULL), a AS (SELECT request_id, lower({_TIDY.format("coalesce(country, '')")}) AS typed, lower(replace({_TIDY.format("coalesce(state, '')")}, '.', '')) AS key FROM rq), "
       "j AS (SELECT request_id, g.country, g.state, row_number() OVER (PARTITION BY request_id ORDER BY coalesce(lower(g.country) = typed OR lower(g.country_code) = typed, false) DESC, geo_id) AS n FROM a JOIN g USING (key) WHERE key <> '') SELECT request_id, country, state FROM j WHERE n = 1")
_query("containing_states", lambda s, d: phrases.containing_states(requests(s, d), table(s, d, "geo_list")),
       f"WITH {_REQ} SELECT request_id, arg_min(g.state, geo_id) AS state FROM rq JOIN geo_list g ON lower(g.city) = lower({_TIDY.format("coalesce(rq.city, '')")}) WHERE g.state IS NOT NULL AND {_TIDY.format("coalesce(rq.state, '')")} = '' AND rq.city IS NOT NULL GROUP BY request_id")


# pages: markup is written from columns, so what must be read from it is known
def _markup(spark: SparkSession, sf: str) -> DataFrame:
    """A page of each extracted record: title, links to mail, phone, services, contact page and other sites, an address."""
    safe = lambda c: F.regexp_replace(X.clean_text(F.col(c)), "[<>&\"'@|•·»«/:–—-]", " ")
    tag = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    mail = F.coalesce(F.get(F.filter("email", lambda e: e.rlike(r"^[a-z]{1,40}@[a-z]{1,40}\.test$")), 0), F.lit(""))
    key = F.pmod("extract_id", F.lit(9973)).cast("string")
    html = tag(
        "<html><head><title>", safe("name"), " | Home</title></head><body><a href='mailto:", mail, "?subject=x'>write</a><a href='tel:+44-20-", F.lpad(key, 7, "1"), "'>call</a><address>", key, " Long Street, Anytown ", key, "</address>",
        "<a href='/contact?x=1#top'>Where</a><a href='/locations'>Find</a><a href='/services/a", key, "'>Work ", key, "</a><a href='/services'>Read more</a><a href='https://other", key, ".test/x'>o</a><a href='https://facebook.com/x'>f</a></body></html>",
    )
    return pages(spark, sf).select("extract_id", F.concat(F.lit("https://www.site"), key, F.lit(".co.uk/")).alias("url"), html.alias("html"), mail.alias("mail"))


def _page_fields(spark: SparkSession, sf: str) -> DataFrame:
    x = H.extract_pages(_markup(spark, sf)).select("extract_id", "page.*")
    return x.select("extract_id", F.array_join("email", ";").alias("email"), F.array_join("phone", ";").alias("phone"), "address", "services", "blocked")


def _page_links(spark: SparkSession, sf: str) -> DataFrame:
    x = H.extract_pages(_markup(spark, sf)).select("extract_id", "page.*")
    return x.select("extract_id", F.explode(F.concat(F.transform("contact_links", lambda u: F.concat(F.lit("contact "), u)), F.transform("external_links", lambda u: F.concat(F.lit("external "), u)))).alias("link"))


_IDS = "pg AS (SELECT DISTINCT extract_id, (extract_id % 9973)::VARCHAR AS k, (list_filter(email, lambda e: regexp_matches(e, '^[a-z]{1,40}@[a-z]{1,40}\\.test$')))[1] AS mail FROM extracted WHERE extract_id IS NOT NULL)"
_BAD = ", ".join(repr(x) for x in C.BAD_EMAIL_PARTS)
_query("page_fields", _page_fields,
       f"WITH {_IDS} SELECT extract_id, CASE WHEN mail IS NULL OR list_bool_or(list_transform([{_BAD}], lambda b: contains(mail, b))) THEN '' ELSE mail END AS email, '+44 20 ' || lpad(k, 7, '1') AS phone, k || ' Long Street, Anytown ' || k AS address, 'Services: Work ' || k AS services, false AS blocked FROM pg")
_query("page_links", _page_links,
       f"WITH {_IDS} SELECT extract_id, unnest(['contact https://www.site' || k || '.co.uk/contact?x=1', 'contact https://www.site' || k || '.co.uk/locations', 'external https://other' || k || '.test/x']) AS link FROM pg")

# duplicates and the whole pipeline
_query("first_listing_by_phone", lambda s, d: dedup.first_wins(places(s, d).withColumn("k", X.norm_phone(F.col("phonenumber"))).filter("k != ''").select("k", "place_key", "title"), ["k"], ["place_key"]), f"WITH {_PLACES}, k AS (SELECT {_phone('phonenumber')} AS k, place_key, title FROM pl) SELECT k, min(place_key) AS place_key, arg_min(title, place_key) AS title FROM k WHERE k <> '' GROUP BY k")


def _unique(spark: SparkSession, sf: str) -> DataFrame:
    keys = dedup.record_keys(F.col("website"), F.col("cid"), F.col("title"), F.array().cast("array<string>"), F.array("phonenumber"))
    return dedup.greedy_unique(places(spark, sf).withColumn("keys", keys), "place_key", "keys").select(F.col("seq").alias("place_key"), "accepted")


_query("unique_records", _unique,
       f"WITH RECURSIVE {_PLACES}, k AS (SELECT row_number() OVER (ORDER BY place_key) AS i, place_key, list_filter([CASE WHEN {_host('website')} <> '' THEN 'd' || {_host('website')} WHEN coalesce(cid, '') <> '' THEN 'dcid:' || cid ELSE '' END, CASE WHEN {_name('title')} <> '' THEN 'n' || {_name('title')} ELSE '' END, CASE WHEN {_phone('phonenumber')} <> '' THEN 'p' || {_phone('phonenumber')} ELSE '' END], lambda x: x <> '') AS keys FROM pl), "
       "f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS place_key, false AS accepted, []::VARCHAR[] AS acc UNION ALL SELECT k.i, k.place_key, NOT list_has_any(f.acc, k.keys), CASE WHEN list_has_any(f.acc, k.keys) THEN f.acc ELSE list_concat(f.acc, k.keys) END FROM f JOIN k ON k.i = f.i + 1) SELECT place_key, accepted FROM f WHERE i > 0")
_query("company_records", flagship, record_sql.company_records(_host, _root, _skip, _clean, _name, _phone, _PLACES, _LOG))
_query("rejected_candidates", lambda s, d: R.judged(R.candidates(table(s, d, "places"), table(s, d, "search_log"), pages(s, d))).groupBy("reason").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score")),
       record_sql.company_records(_host, _root, _skip, _clean, _name, _phone, _PLACES, _LOG, reasons=True))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
