"""Records of the same organisation under different spellings of its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions.text import root_domain
from gleanwork.llm.addresses import parse_addresses
from gleanwork.llm.names import name_words, similar_names
from gleanwork.operators.skew import join_group_facts, join_salted
from gleanwork.session import cut

#: Similarity of names from which two spellings belong to one organisation.
SAME_NAME = 0.82
#: Names times cities of a site, above which the two are not paired.
MOST_NAMES = 10_000


def site_of(url: Column) -> Column:
    """The registrable part of the host, without scheme, user, subdomain, port and path; null if there is none."""
    host = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    site = root_domain(host)
    return F.when(site.contains("."), site)


def blank(col: Column) -> Column:
    return F.coalesce(~col.rlike(r"[^\s ]"), F.lit(True))


def _places_of_sites(mine: DataFrame, sites: DataFrame) -> DataFrame:
    """(place_key, site, block) whose names are variants; ``mine`` (place_key, block, words), ``sites`` (site, block, words)."""
    links = similar_names(mine, sites, SAME_NAME)
    key = F.xxhash64("block", "words")
    rows = mine.select(key.alias("k"), "place_key")
    sizes = cut(rows.groupBy("k").count())
    named = cut(join_salted(rows, links.select(F.xxhash64("block", F.col("left")).alias("k"), F.xxhash64("block", F.col("right")).alias("s"), "block"), "k", sizes, "count", rows.count()))
    of = sites.select(key.alias("s"), "site")
    return join_salted(of, named.select("s", "place_key", "block"), "s", of.groupBy("s").agg(F.count("*").alias("n")), "n", of.count()).select("place_key", "site", "block").distinct()


def variant_links(places: DataFrame, extracted: DataFrame, geo: DataFrame) -> DataFrame:
    """(place_key, extract_id) for each place without website and phone and each extracted record
    of the same organisation.

    Records of one site are one organisation; it has all names and cities its pages give, and the
    cities of the places that list the site. A place belongs to a site of its city if one name of
    the site is a variant of the place's title; to a site without any city, if its names are met in
    one city only. Null and blank names and places without a city
    match nothing; repeated keys count once; ties are all kept.
    """
    _, pages, to_site = _matched(places, extracted, geo)
    per_site = pages.groupBy("site").count()
    out = join_salted(pages.select("site", "extract_id"), to_site, "site", per_site, "count", pages.count())
    return out.select("place_key", "extract_id").distinct()


def variant_classes(places: DataFrame, extracted: DataFrame, geo: DataFrame) -> DataFrame:
    """(side, id, class, links): each place without website and phone by its name and city, each record by its site, and its number of links."""
    mine, pages, to_site = _matched(places, extracted, geo)
    records = pages.select("extract_id", "site").distinct()
    per_site = records.groupBy("site").agg(F.count("*").alias("n"))
    met = to_site.groupBy("site").agg(F.count("*").alias("links"))
    facts = per_site.join(met, "site", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    of_records = join_group_facts(records, facts, "site", "n", records.count()).select(F.lit("extract_id").alias("side"), F.col("extract_id").alias("id"), F.xxhash64("site").alias("class"), "links")
    of_places = to_site.join(per_site, "site").groupBy("place_key").agg(F.sum("n").alias("links"))
    own = mine.select("place_key", F.xxhash64("block", "words").alias("class")).join(of_places, "place_key", "left")
    return own.select(F.lit("place_key").alias("side"), F.col("place_key").alias("id"), "class", F.coalesce("links", F.lit(0)).alias("links")).unionByName(of_records)


def _matched(places: DataFrame, extracted: DataFrame, geo: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The places asked for (place_key, block, words), the records (extract_id, site, ...), and (place_key, site) that are one organisation."""
    rows = places.filter("place_key is not null").select("place_key", "title", "website", "phonenumber", "address").distinct()
    rows = cut(rows.select("place_key", "title", "address", site_of(F.col("website")).alias("site"), (blank(F.col("website")) & blank(F.col("phonenumber"))).alias("asked")))
    # a place that is neither asked for nor lists a site tells nothing
    located = cut(parse_addresses(rows.filter("asked or site is not null"), "address", geo, fields="city string").select("place_key", "site", "asked", F.when(F.col("asked"), F.col("title")).alias("title"), F.col("at.city").alias("block")))
    mine = cut(located.filter("asked").select("place_key", "block", name_words("title").alias("words")))
    pages = cut(extracted.filter("extract_id is not null").select("extract_id", site_of(F.col("url")).alias("site"), "name", "address").distinct()).filter("site is not null")
    pages = cut(parse_addresses(pages, "address", geo, fields="city string").select("extract_id", "site", name_words("name").alias("words"), F.col("at.city").alias("block")))
    cities = cut(pages.select("site", "block").filter("block is not null").unionByName(located.select("site", "block").filter("site is not null and block is not null")).distinct())
    spelled = cut(pages.filter("size(words) > 0").select("site", "words").distinct())
    # a platform has too many names for too many cities to pair them: its names are compared anywhere, its cities afterwards
    many = spelled.groupBy("site").agg(F.count("*").alias("a")).join(cities.groupBy("site").agg(F.count("*").alias("b")), "site")
    platforms = cut(many.filter(F.col("a") * F.col("b") > MOST_NAMES).select("site"))
    adrift, anywhere = F.lit("").alias("block"), F.lit("*").alias("block")
    sites = cut(
        spelled.join(platforms, "site", "left_anti").join(cities, "site").select("site", "block", "words")
        .unionByName(spelled.join(platforms, "site", "left_semi").select("site", anywhere, "words"))
        .unionByName(spelled.join(cities, "site", "left_anti").select("site", adrift, "words"))
    )
    asked = cut(mine.unionByName(mine.select("place_key", anywhere, "words")).unionByName(mine.select("place_key", adrift, "words")).filter("block is not null"))
    met = cut(_places_of_sites(asked, sites))
    where = mine.select("place_key", F.col("block").alias("city"))
    there = met.filter("block = '*'").join(where, "place_key").join(cities.withColumnRenamed("block", "city"), ["site", "city"], "left_semi").select("place_key", "site")
    to_site = cut(met.filter("block not in ('', '*')").select("place_key", "site").unionByName(there).distinct())
    # a site without a city: its names are met in one city only, at places that have no site there
    at_large = cut(met.filter("block = ''").join(to_site, "place_key", "left_anti").join(where, "place_key"))
    one_city = at_large.groupBy("site").agg(F.min("city").alias("a"), F.max("city").alias("b")).filter("a = b").select("site")
    to_site = cut(to_site.unionByName(at_large.join(one_city, "site", "left_semi").select("place_key", "site")).distinct())
    return mine, pages, to_site
