"""The record pipeline: listings and crawled pages to validated, scored and deduplicated company records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleanwork.functions import constants as C
from gleanwork.functions import rules
from gleanwork.functions import text as X
from gleanwork.operators.dedup import greedy_unique, merge_missing, record_keys, up_to_target
from gleanwork.operators.skew import join_group_facts
from gleanwork.session import cut

#: What is kept of a record, and pages of contacts that are read beside a site's first page.
MOST_EMAILS, MOST_PHONES, LONGEST_NAME, LONGEST_SERVICES, PAGES_OF_SITE, PAGES_OF_PLACE = 3, 2, 150, 500, 2, 1
#: Records of pages are ordered after those of listings.
AFTER_LISTINGS = 1 << 50
FIELDS = ["seq", "company_name", "category", "official_website", "email", "phone", "full_business_address", "industry", "services", "cid", "search_query", "source_url", "source_page"]


def _strings(col: Column) -> Column:
    return F.coalesce(col, F.array().cast("array<string>"))


def site_contacts(pages: DataFrame) -> DataFrame:
    """(domain, home, first, second): what the first page of each site and its pages of contacts say.

    ``pages`` has (extract_id, url, name, email, phone, address, services). The first page is the one
    with the shortest path; pages of contacts are those whose url says so, 'contact' before others.
    Each is a struct; at most two pages of contacts are read, as many rows a site are shuffled.
    """
    path = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?[^/?#]*(.*)$", 1)
    said = F.struct("url", "name", _strings(F.col("email")).alias("email"), _strings(F.col("phone")).alias("phone"), X.clean_text(F.col("address")).alias("address"), X.clean_text(F.col("services")).alias("services"))
    x = pages.filter("extract_id is not null").select("extract_id", X.norm_domain(F.col("url")).alias("domain"), F.lower(path).alias("path"), said.alias("said")).filter("domain != ''")
    home = x.groupBy("domain").agg(F.min_by("said", F.struct(F.length("path"), "extract_id")).alias("home"), F.min("extract_id").alias("first_id"), F.count("*").alias("pages"))
    rank = F.row_number().over(W.partitionBy("domain").orderBy(~F.col("path").contains("contact"), "extract_id"))
    contact = x.filter(F.col("path").rlike("(?i)" + C.CONTACT_LINK)).withColumn("n", rank).filter(F.col("n") <= PAGES_OF_SITE)
    two = contact.groupBy("domain").agg(*[F.max(F.when(F.col("n") == i, F.col("said"))).alias(name) for i, name in ((1, "first"), (2, "second"))])
    return home.join(two, "domain", "left")


def _merged(home: Column, *others: Column) -> Column:
    """A struct of contacts in which what ``home`` lacks comes from the others in order, as long as something is missing."""
    full = lambda s: (F.size(s["email"]) > 0) & (F.size(s["phone"]) > 0) & (s["address"] != "")
    out = F.struct(home["email"].alias("email"), home["phone"].alias("phone"), home["address"].alias("address"), home["services"].alias("services"), home["name"].alias("name"), home["url"].alias("page"))
    def filled(o: Column):
        lacks = lambda s, c: (F.size(s[c]) == 0) & (F.size(o[c]) > 0)

        def both(s: Column) -> Column:
            first = lambda c: F.when(X.text(s[c]) != "", s[c]).otherwise(o[c]).alias(c)
            gained = lacks(s, "email") | lacks(s, "phone") | ((s["address"] == "") & (o["address"] != ""))
            more = F.struct(
                merge_missing(s["email"], o["email"], MOST_EMAILS).alias("email"), merge_missing(s["phone"], o["phone"], MOST_PHONES).alias("phone"), first("address"), first("services"), first("name"), F.when(gained, o["url"]).otherwise(s["page"]).alias("page"),
            )
            return F.when(o.isNull() | full(s), s).otherwise(more)

        return both

    for o in others:
        out = X.once(out, filled(o))
    return out


def listing_candidates(places: DataFrame, log: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """One candidate for each listing, with the query that found it and, from its own site, e-mail and services.

    The site of a directory, a social or a public one is blanked. ``sites`` are ``site_contacts``.
    """
    asked = log.filter("seq is not null").groupBy("seq").agg(F.max("query").alias("search_query"))
    p = places.filter("place_key is not null").groupBy("place_key").agg(F.max_by(F.struct("seq", "title", "website", "cid", "phonenumber", "address", "category"), F.struct("fetched_at", "title")).alias("p")).select("place_key", "p.*")
    with_scheme = F.when(X.text(F.col("website")).contains("://"), F.col("website")).otherwise(F.concat(F.lit("http://"), F.col("website")))
    site = F.when(X.is_skip_domain(F.col("website")), "").otherwise(X.site_url(with_scheme))
    c = p.join(asked, "seq", "left").select(
        F.col("place_key").alias("seq"), F.substring(X.clean_text(F.col("title")), 1, LONGEST_NAME).alias("company_name"), X.text(F.col("category")).alias("category"), F.coalesce(site, F.lit("")).alias("official_website"),
        X.clean_text(F.col("phonenumber")).alias("said_phone"), X.clean_text(F.col("address")).alias("full_business_address"), X.clean_text(F.col("category")).alias("industry"), X.text(F.col("cid")).alias("cid"), X.text(F.col("search_query")).alias("search_query"),
        F.when(X.text(F.col("cid")) != "", F.concat(F.lit("listing:"), "cid")).otherwise("listing").alias("source_url"), X.norm_domain(site).alias("domain"),
    )
    none = F.lit(None).cast("struct<email:array<string>,phone:array<string>,address:string,services:string,name:string,page:string>")
    if sites is None:
        c = c.withColumn("said", none)
    else:
        read = sites.select("domain", _merged(F.col("home"), F.when(F.size("home.email") == 0, F.col("first"))).alias("said"))
        sizes = c.filter("domain != ''").groupBy("domain").agg(F.count("*").alias("n"))
        own, rest = cut(c), None
        found = join_group_facts(own.filter("domain != ''"), read.join(sizes, "domain"), "domain", "n", own.count()).drop("n")
        rest = own.filter("domain = ''").unionByName(own.filter("domain != ''").join(read.select("domain"), "domain", "left_anti").select(own.columns)).withColumn("said", none)
        c = found.unionByName(rest)
    services = F.substring(F.array_join(F.filter(F.array("industry", F.col("said.services")), lambda s: X.text(s) != ""), " | "), 1, LONGEST_SERVICES)
    return c.withColumn("email", F.slice(_strings(F.col("said.email")), 1, MOST_EMAILS)).withColumn("phone", F.filter(F.array("said_phone"), lambda p: p != "")).withColumn("services", services).withColumn("source_page", X.text(F.col("said.page"))).select(*FIELDS)


def page_candidates(sites: DataFrame, known: DataFrame) -> DataFrame:
    """One candidate for each crawled site that no listing has: not a directory, with an e-mail or a phone.

    ``known`` has the domains (domain) of the listings.
    """
    fresh = sites.join(known.select("domain").distinct(), "domain", "left_anti").filter(~X.is_skip_domain(F.col("domain")))
    x = fresh.select("domain", "first_id", F.col("home.url").alias("url"), _merged(F.col("home"), F.col("first"), F.col("second")).alias("s"))
    x = x.filter((F.size("s.email") > 0) | (F.size("s.phone") > 0))
    with_scheme = F.when(F.col("url").contains("://"), F.col("url")).otherwise(F.concat(F.lit("http://"), "url"))
    name = F.when(X.text(F.col("s.name")) != "", F.col("s.name")).otherwise(F.col("domain"))
    blank = F.lit("")
    return x.select(
        (F.col("first_id") + AFTER_LISTINGS).alias("seq"), F.substring(X.clean_text(name), 1, LONGEST_NAME).alias("company_name"), blank.alias("category"), X.site_url(with_scheme).alias("official_website"),
        F.slice("s.email", 1, MOST_EMAILS).alias("email"), F.slice("s.phone", 1, MOST_PHONES).alias("phone"), F.col("s.address").alias("full_business_address"), blank.alias("industry"), F.substring("s.services", 1, LONGEST_SERVICES).alias("services"),
        blank.alias("cid"), blank.alias("search_query"), F.col("url").alias("source_url"), F.col("s.page").alias("source_page"),
    )


def candidates(places: DataFrame, log: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """All candidates: the listings, and the sites of ``pages`` that no listing has."""
    if pages is None:
        return listing_candidates(places, log)
    sites = cut(site_contacts(pages))
    known = places.select(X.norm_domain(F.col("website")).alias("domain")).filter("domain != ''")
    return listing_candidates(places, log, sites).unionByName(page_candidates(sites, known))


def judged(c: DataFrame) -> DataFrame:
    """Candidates with the reason against them (blank if none) and their confidence."""
    email, phone = F.array_join("email", "; "), F.array_join("phone", "; ")
    listed = F.col("seq") < AFTER_LISTINGS
    reason = rules.rejection(F.col("company_name"), F.col("official_website"), email, phone, F.col("full_business_address"), listed & (F.col("cid") != ""))
    terms = F.filter(F.split(F.lower("category"), "[^a-z]+"), lambda t: F.length(t) > 3)
    relevance = rules.relevant(terms, F.col("company_name"), F.col("services"), F.col("search_query"))
    score = rules.confidence(F.col("company_name"), F.col("official_website"), email, phone, F.col("full_business_address"), relevance)
    return c.withColumn("reason", reason).withColumn("score", score)


def located(records: DataFrame, city: str = "", state: str = "", country: str = "", location: str = "") -> DataFrame:
    """``records`` with city, state and country of their address; what it lacks comes from the place asked for.

    The free text ``location`` counts only where no other field of the request is filled.
    """
    hint = "" if city or state or country else location
    at = X.split_address(F.col("full_business_address"), F.lit(hint))
    filled = lambda field, asked: F.when(F.col(f"_at.{field}") != "", F.col(f"_at.{field}")).otherwise(F.lit(asked)).alias(field)
    return records.withColumn("_at", at).select(*records.columns, filled("city", city), filled("state", state), filled("country", country))


def verdicts(good: DataFrame) -> DataFrame:
    """(seq, accepted, duplicate_of) of valid candidates: first wins by domain or listing, name, e-mails and phones."""
    keyed = good.withColumn("keys", record_keys(F.col("official_website"), F.col("cid"), F.col("company_name"), F.col("email"), F.col("phone")))
    return greedy_unique(keyed, "seq", "keys")


def records(places: DataFrame, log: DataFrame, pages: DataFrame | None = None, target: int | None = None) -> DataFrame:
    """Accepted records: valid, first in order with each domain, name, e-mail and phone, up to ``target`` a category."""
    good = cut(judged(candidates(places, log, pages)).filter("reason = ''").drop("reason"))
    kept = good.join(verdicts(good).filter("accepted").select("seq"), "seq")
    if target is not None:
        kept = up_to_target(kept, ["category"], "seq", target)
    shown = located(kept).withColumn("business_email", F.array_join("email", "; ")).withColumn("business_phone", F.array_join("phone", "; "))
    return shown.drop("email", "phone", "cid")


def valid_by_search(places: DataFrame) -> DataFrame:
    """(seq, valid): the number of valid listings each search led to."""
    bad = rules.rejection(F.col("title"), F.col("website"), F.lit(""), F.col("phonenumber"), F.col("address"), X.text(F.col("cid")) != "")
    return places.filter("seq is not null").filter(bad == "").groupBy("seq").agg(F.count("*").alias("valid"))
