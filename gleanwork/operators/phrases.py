"""Phrases and queries generated from what a user asks for, as array expressions: no shuffle, one row a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleanwork.functions import constants as C
from gleanwork.functions import text as X


def tidied(col: Column) -> Column:
    return F.trim(F.regexp_replace(X.text(col), r"(?U)\s+", " "))


def distinct_phrases(phrases: Column) -> Column:
    """The phrases in their order without blank ones; of those that differ in letter case only the first."""

    def first(kept: Column) -> Column:
        return X.once(F.transform(kept, F.lower), lambda low: F.filter(F.transform(kept, lambda p, i: F.when(F.array_position(low, F.lower(p)) == i + 1, p)), lambda p: p.isNotNull()))

    return X.once(F.filter(F.transform(phrases, tidied), lambda p: p != ""), first)


def core_name(name: Column) -> Column:
    """A category's name without generic words, the whole name if nothing else is left."""
    words = F.filter(F.split(tidied(name), " "), lambda w: ~F.lower(w).isin(C.GENERIC_WORDS))
    return X.once(F.array_join(words, " "), lambda c: F.when(c != "", c).otherwise(tidied(name)))


def custom_templates(name: Column) -> Column:
    """Phrases for a category of the user's own; each is followed by ' in ' and a place."""
    core = core_name(name)
    return F.array(tidied(name), F.concat(core, F.lit(" companies")), F.concat(core, F.lit(" services")))


def custom_terms(name: Column, keywords: Column) -> Column:
    """Terms that make a record relevant: the name and the words of the name and of the keywords that are not generic."""
    words = F.flatten(F.transform(F.concat(F.array(X.text(name)), keywords), lambda s: F.split(F.lower(s), "[^A-Za-z0-9+#]+")))
    told = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(C.GENERIC_WORDS))
    return F.array_distinct(F.concat(F.array(F.lower(X.text(name))), told))


def search_phrases(name: Column, keywords: Column) -> Column:
    """The phrases of a request in order: its keywords, then the templates of its category."""
    return distinct_phrases(F.concat(keywords, custom_templates(name)))


def expansion_phrases(name: Column, keywords: Column) -> Column:
    """Further phrases for when the others are used up: keywords and category with other words for a business."""
    bases = F.concat(keywords, F.array(core_name(name)))
    return distinct_phrases(F.flatten(F.transform(bases, lambda b: F.transform(F.array(*[F.lit(s) for s in C.EXPANSION_SUFFIXES]), lambda s: F.concat(b, F.lit(" "), s)))))


def query_pool(name: Column, keywords: Column, location: Column, cities: Column, most: Column) -> Column:
    """The queries of a request in order, ``most`` at most.

    First keywords and templates at the place asked for, then one phrase after the other in every
    city, then both again with each modifier.
    """
    keys = F.filter(F.transform(keywords, tidied), lambda k: k != "")
    at = lambda phrase, place: F.when(X.text(place) != "", F.concat(phrase, F.lit(" in "), place)).otherwise(phrase)
    here = lambda phrases: F.transform(phrases, lambda p: at(p, tidied(location)))
    there = lambda phrases: F.flatten(F.transform(phrases, lambda p: F.transform(cities, lambda c: F.concat(p, F.lit(" in "), c))))
    own = custom_templates(name)
    base = F.concat(F.flatten(F.transform(keys, lambda k: F.array(at(k, tidied(location)), at(F.concat(k, F.lit(" companies")), tidied(location))))), here(own))
    mods = F.array(*[F.lit(m) for m in C.QUERY_MODIFIERS])
    said = lambda queries: F.transform(queries, lambda q: q)
    with_mod = lambda make: F.flatten(F.transform(mods, lambda m: F.transform(make, lambda q: F.concat(m, F.lit(" "), q))))
    pool = F.concat(said(base), there(keys), there(own), with_mod(F.concat(here(own), here(keys))), with_mod(F.concat(there(keys), there(own))))
    return F.slice(distinct_phrases(pool), 1, most)


def unique_slugs(names: DataFrame, name: str, order: str) -> DataFrame:
    """(name, slug) of the distinct names, in any letter case, in order; the second of one slug ends in _2, and so on."""
    first = names.select(tidied(F.col(name)).alias("name"), order).filter("name != ''").groupBy(F.lower("name").alias("_k")).agg(F.min_by("name", order).alias("name"), F.min(order).alias("at"))
    slugged = first.withColumn("base", X.slug(F.col("name")))
    n = F.row_number().over(W.partitionBy("base").orderBy("at", "name"))
    return slugged.withColumn("n", n).select("name", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("n").cast("string"))).alias("slug"))


def resolved_states(requests: DataFrame, geo: DataFrame) -> DataFrame:
    """(request_id, country, state) of each request (request_id, country, state) whose state is listed.

    A state is written out or abbreviated, in any letter case, with or without full stops. That of
    the country typed goes first, then the first one listed.
    """
    states = geo.filter("state is not null and city is null").select("geo_id", F.col("country").alias("in_country"), F.col("country_code").alias("in_code"), F.col("state").alias("full"), F.explode(F.array_distinct(F.array(F.lower("state"), F.lower(F.coalesce("state_code", "state"))))).alias("key"))
    asked = requests.filter("request_id is not null").select("request_id", F.lower(tidied(F.col("country"))).alias("typed"), F.lower(F.replace(tidied(F.col("state")), F.lit("."), F.lit(""))).alias("key")).filter("key != ''").distinct()
    met = asked.join(states, "key")
    own = (F.lower("in_country") == F.col("typed")) | (F.lower("in_code") == F.col("typed"))
    best = met.groupBy("request_id").agg(F.min_by(F.struct(F.col("in_country").alias("country"), F.col("full").alias("state")), F.struct(~F.coalesce(own, F.lit(False)), "geo_id")).alias("s"))
    return best.select("request_id", "s.*")


def containing_states(requests: DataFrame, geo: DataFrame) -> DataFrame:
    """(request_id, state) of the requests (request_id, city, state) without a state whose city is listed, the first one listed."""
    cities = geo.filter("state is not null and city is not null").select("geo_id", F.lower("city").alias("key"), F.col("state").alias("full"))
    asked = requests.filter("request_id is not null").filter(tidied(F.col("state")) == "").select("request_id", F.lower(tidied(F.col("city"))).alias("key")).filter("key != ''").distinct()
    return asked.join(cities, "key").groupBy("request_id").agg(F.min_by("full", "geo_id").alias("state"))
