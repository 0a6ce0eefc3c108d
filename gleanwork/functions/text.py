"""Scalar functions on URLs, names, contacts and queries, as JVM-side column expressions.

Null counts as blank everywhere; results are never null unless stated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanwork.functions import constants as C


def _in(col: Column, values: list[str]) -> Column:
    return col.isin(values)


def text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def clean_text(col: Column) -> Column:
    """Without control characters, white space collapsed and trimmed."""
    kept = F.regexp_replace(text(col), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"(?U)\s+", " "), r"^ | $", "")


def norm_domain(url: Column) -> Column:
    """Host in lower case, without user, port and one leading www."""
    u = text(url)
    full = F.when(u.contains("://"), u).otherwise(F.concat(F.lit("http://"), u))
    host = F.lower(F.regexp_extract(full, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":.*$", ""), r"^www\.", "")


def root_domain(url: Column) -> Column:
    """The registrable part of the host: its last two labels, or three under a second-level suffix."""

    def shortened(d: Column, labels: Column) -> Column:
        three = (F.size(labels) >= 3) & F.coalesce(F.get(labels, F.size(labels) - 2).isin(C.SECOND_LEVEL), F.lit(False)) & (F.length(F.get(labels, F.size(labels) - 1)) == 2)
        return F.when(three, F.array_join(F.slice(labels, -3, 3), ".")).when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(d)

    return once(norm_domain(url), lambda d: once(F.filter(F.split(d, r"\."), lambda x: x != ""), lambda labels: shortened(d, labels)))


def is_skip_domain(url: Column) -> Column:
    """Search engines, social sites, directories, media and public bodies; blank counts too."""

    def listed(rd: Column) -> Column:
        public = rd.rlike(r"\.(gov|edu|mil)$|\.(gov|edu|ac)\.")
        media = F.regexp_replace(rd, r"\.[^.]*$", "").rlike("(?iU)" + C.MEDIA_DOMAIN)
        return (rd == "") | _in(rd, C.SKIP_DOMAINS) | public | media

    return once(root_domain(url), listed)


def is_aggregator(url: Column) -> Column:
    return _in(root_domain(url), C.AGGREGATOR_DOMAINS)


def crawl_key(url: Column) -> Column:
    """Host and path of a page of a directory, otherwise the host."""
    u = text(url)
    full = F.when(u.contains("://"), u).otherwise(F.concat(F.lit("http://"), u))
    path = F.regexp_replace(F.regexp_extract(full, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1), r"/+$", "")
    return F.when(is_skip_domain(u), F.lower(F.concat(norm_domain(u), path))).otherwise(norm_domain(u))


def site_url(url: Column) -> Column:
    """Scheme and host in lower case; blank if there is none."""
    parts = F.regexp_extract(text(url), r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)", 1)
    host = F.regexp_extract(text(url), r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)", 2)
    return F.when(parts != "", F.concat(F.lower(parts), F.lit("://"), F.lower(host))).otherwise(F.lit(""))


def client_folder(client: Column) -> Column:
    return F.substring(F.sha2(text(client), 256), 1, 32)


def norm_name(name: Column) -> Column:
    """Letters and digits of a name without legal suffixes; blank if fewer than four."""
    n = F.regexp_replace(F.regexp_replace(F.lower(text(name)), "(?iU)" + C.LEGAL_SUFFIXES, " "), "[^a-z0-9]+", "")
    return F.when(F.length(n) >= 4, n).otherwise(F.lit(""))


def norm_email(email: Column) -> Column:
    return F.lower(F.regexp_replace(text(email), r"(?U)^\s+|\s+$", ""))


def norm_phone(phone: Column) -> Column:
    """The last ten digits; blank if there are fewer than eight."""
    digits = F.regexp_replace(text(phone), r"(?U)\D", "")
    return F.when(F.length(digits) >= 8, F.right(digits, F.lit(10))).otherwise(F.lit(""))


def cell_safe(col: Column) -> Column:
    """Text that a spreadsheet does not run as a formula, at most 32,000 characters."""
    s = clean_text(col)
    return F.substring(F.when(s.rlike(r"^[=+@]"), F.concat(F.lit(" "), s)).otherwise(s), 1, 32000)


def clean_title(title: Column) -> Column:
    """The first part of a page title that says something, at most 120 characters."""
    parts = F.transform(F.split(clean_text(title), C.TITLE_SPLIT), lambda p: F.btrim(p, F.lit(C.TITLE_EDGE)))
    said = F.filter(parts, lambda p: (F.length(p) >= 2) & ~F.lower(p).isin(C.TITLE_PARTS))
    return F.substring(F.coalesce(F.get(said, 0), F.lit("")), 1, 120)


def find_emails(col: Column) -> Column:
    """Addresses in a text in order, distinct, in lower case, without junk."""
    found = F.regexp_extract_all(text(col), F.lit(f"({C.EMAIL})"), F.lit(1))
    bare = F.transform(found, lambda e: F.lower(F.regexp_replace(e, r"^[.\-_]+|[.\-_]+$", "")))
    bad = lambda e: F.greatest(*[e.contains(p) for p in C.BAD_EMAIL_PARTS])
    return F.array_distinct(F.filter(bare, lambda e: (F.length(e) <= 80) & ~bad(e)))


def valid_phone(candidate: Column) -> Column:
    """8 to 15 digits, more than two distinct ones, neither a date, a range of years nor plain counting."""
    c = F.trim(text(candidate))
    digits = F.regexp_replace(c, r"(?U)\D", "")
    enough = F.length(digits).between(8, 15) & (F.size(F.array_distinct(F.split(digits, ""))) > 2)
    return enough & ~c.rlike(C.DATE_LIKE) & ~c.rlike(C.YEAR_RANGE) & ~digits.isin(C.SEQUENTIAL_DIGITS)


def find_phones(col: Column, most: int | None = None) -> Column:
    """Phone numbers in a text, the first of each digit string, in order; all of them, or the first ``most``."""
    found = F.filter(F.regexp_extract_all(text(col), F.lit(f"({C.PHONE})"), F.lit(1)), valid_phone)
    keyed = F.transform(found, lambda p: F.struct(F.regexp_replace(p, r"\D", "").alias("digits"), F.trim(p).alias("shown")))
    first = F.filter(F.transform(keyed, lambda x, i: F.when(F.array_position(F.transform(keyed, lambda k: k.digits), x.digits) == i + 1, x.shown)), lambda p: p.isNotNull())
    return first if most is None else F.slice(first, 1, most)


def split_address(address: Column, hint: Column) -> Column:
    """Struct (city, state, country) of a comma-separated address; the hint fills in what is missing."""
    h = clean_text(hint)
    bare = lambda p: F.trim(F.regexp_replace(p, C.POSTCODE, ""))
    fits = lambda p: (p != "") & ~p.rlike(r"(?U)\d") & (F.length(p) <= 40)
    end = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(""))
    shorter = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    kept = lambda t: F.when(fits(t), t).otherwise("")

    def read(parts: Column) -> Column:
        named = F.lower(end(parts)).isin(C.COUNTRIES)
        country = F.when(named, end(parts)).when(F.lower(h).isin(C.COUNTRIES), h).otherwise("")
        return once(F.struct(country.alias("country"), F.when(named, shorter(parts)).otherwise(parts).alias("rest")), with_state)

    def with_state(x: Column) -> Column:
        state = once(bare(end(x.rest)), kept)
        return once(F.struct(x.country.alias("country"), x.rest.alias("rest"), state.alias("state")), with_city)

    def with_city(x: Column) -> Column:
        left = F.when(x.state != "", shorter(x.rest)).otherwise(x.rest)
        return once(F.struct(once(bare(end(left)), kept).alias("city"), x.state.alias("state"), x.country.alias("country")), hinted)

    def hinted(x: Column) -> Column:
        none = (h != "") & (x.country == "") & (x.state == "") & (x.city == "")
        return F.struct(F.when(none, h).otherwise(x.city).alias("city"), x.state.alias("state"), x.country.alias("country"))

    return once(F.filter(F.transform(F.split(text(address), ","), clean_text), lambda p: p != ""), read)


def _stem(w: Column) -> Column:
    return F.when((F.length(w) > 3) & w.endswith("ies"), F.concat(F.regexp_replace(w, "ies$", ""), F.lit("y"))).when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(w)


def canon_phrase(phrase: Column) -> Column:
    """The distinct stems of a phrase in order, without filler and business nouns, if any are left."""
    stems = F.transform(F.regexp_extract_all(F.lower(text(phrase)), F.lit("([a-z0-9&+#]+)"), F.lit(1)), _stem)
    kept = lambda all_: F.filter(all_, lambda w: ~w.isin(C.FILLER_WORDS) & ~w.isin(C.BUSINESS_NOUNS))
    return once(stems, lambda s: F.array_join(F.array_sort(F.array_distinct(F.when(F.size(kept(s)) > 0, kept(s)).otherwise(s))), " "))


def canon_place(place: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text(place)), F.lit("([a-z0-9]+)"), F.lit(1)), " ")


def norm_query(query: Column) -> Column:
    """``phrase@place`` of a query 'phrase in place', cut at the last ' in '."""
    q = F.trim(F.regexp_replace(F.lower(text(query)), r"(?U)\s+", " "))
    has = q.rlike("^(.*) in (.*)$")
    phrase = F.when(has, F.regexp_extract(q, "^(.*) in (.*)$", 1)).otherwise(q)
    return F.concat(canon_phrase(phrase), F.lit("@"), canon_place(F.when(has, F.regexp_extract(q, "^(.*) in (.*)$", 2)).otherwise("")))


def ledger_key(kind: Column, query: Column, page: Column) -> Column:
    page = F.when(F.coalesce(page, F.lit(0)) == 0, 1).otherwise(page)
    return F.concat_ws("|", text(kind), norm_query(query), F.concat(F.lit("p"), page.cast("string")))


def query_text(phrase: Column, place: Column) -> Column:
    return F.when(text(place) != "", F.concat(phrase, F.lit(" in "), place)).otherwise(phrase)


def slug(name: Column) -> Column:
    kept = F.substring(F.regexp_replace(F.regexp_replace(text(name), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""), 1, 40)
    return F.concat(F.lit("Custom_"), F.when(kept != "", kept).otherwise("Category"))


def suggested_keywords(terms: Column) -> Column:
    return F.transform(F.slice(terms, 1, 8), lambda t: F.when(F.length(t) <= 3, F.upper(t)).otherwise(F.initcap(t)))


def client_address(forwarded: Column, hops: int) -> Column:
    """The hops-th address from the right of a forwarded-for list; null if there are fewer."""
    return F.trim(F.try_element_at(F.split(forwarded, ","), F.lit(-hops)))


def backoff_seconds(attempt: Column, retry_after: Column, jitter: Column) -> Column:
    return F.least(F.lit(30.0), F.greatest(F.pow(F.lit(2.0), attempt - 1) * (1 + 0.5 * jitter), F.coalesce(retry_after, F.lit(0.0))))


def unwrap_redirect(href: Column) -> Column:
    """The target of a search engine's redirect link (uddg parameter, or base64 behind 'a1'); else the link."""
    target = F.regexp_extract(text(href), r"[?&]uddg=([^&#]+)", 1)
    code = F.regexp_extract(text(href), r"[?&]u=a1([A-Za-z0-9_\-]+)", 1)
    padded = F.concat(F.translate(code, "-_", "+/"), F.repeat(F.lit("="), ((4 - F.length(code) % 4) % 4).cast("int")))
    decoded = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when(target != "", F.try_url_decode(target)).when(code != "", decoded).otherwise(text(href))


def url_block_reason(url: Column) -> Column:
    """Why a URL may not be fetched, from what is written in it; blank if nothing is against it."""
    u = text(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), r"^.*@", ""), r":\d+$", ""))
    port = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*:(\d+)(?:[/?#]|$)", 1)
    inner = host.rlike(r"^(127|10|0)\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2\d|3[01])\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^2(2[4-9]|[3-5]\d)\.")
    # a host of one number, or with octal or hexadecimal parts, is an address in disguise
    odd = host.rlike(r"^(0x[0-9a-f]+|\d+)(\.(0x[0-9a-f]+|\d+)){0,3}\.?$") & ~host.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$")
    six = host.rlike(r"^\[(::1?|f[cd].*|fe[89ab].*|ff.*|::ffff:.*)\]$")
    return (
        F.when(~scheme.isin("http", "https"), F.lit("scheme")).when(host == "", F.lit("host")).when((port != "") & ~port.isin("80", "443", "8080", "8443"), F.lit("port"))
        .when(host.rlike(r"^localhost$|^metadata\.|\.(local|internal|localhost|lan|home|corp)$"), F.lit("name")).when(inner | odd | six, F.lit("address")).otherwise(F.lit(""))
    )
