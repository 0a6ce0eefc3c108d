"""Records whose addresses denote the same building, matched level by level from the top.

Region and city come from the gazetteer and are sets: the entries a name may mean, and all cities
that an address without one may inherit, those of addresses with its postcode, or else of its
region. Below, a building of a candidate city is its house number, kind and direction of the
street, and a street name at most two typing errors away, one if a name is short; a text that can
be read in two ways takes part with both street names. Ambiguous cities stay apart until the
levels below decide. The unit is not compared. All joins of addresses are shuffled, none is a broadcast.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.llm.addresses import near, parse_addresses
from gleanwork.llm.names import sound
from gleanwork.operators.skew import join_group_facts, join_salted, shuffled
from gleanwork.session import cut

PARTS = ["city", "places", "region", "parents", "postcode", "number", "street", "other", "kind", "direction"]


@F.pandas_udf(T.BooleanType())
def _same_street(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([near(sound(x), sound(y), 2 if min(len(x), len(y)) > 6 else 1) for x, y in zip(a, b)])


def _sound(street: Column) -> Column:
    """``sound`` as a column."""
    for a, b in (("ck", "k"), ("ks", "x"), ("ph", "f")):
        street = F.replace(street, F.lit(a), F.lit(b))
    return F.translate(street, "yw", "iv")


def _readings(df: DataFrame) -> DataFrame:
    """Each address (place, ...) once for each reading of its street, with ``sound``."""
    each = F.explode(F.array_compact(F.array("street", "other")))
    return df.withColumn("street", each).withColumn("sound", _sound(F.col("street")))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r): addresses (place, key, number, kind, direction, street, sound) of one key at one building.

    The four equal parts are joined as one hash, so a row is that, the id and the street's name.
    Two swaps of neighbours are four edits at most, which the JVM tells first.
    """
    side = lambda df, s: df.select(F.xxhash64("key", "number", "kind", "direction").alias("k"), F.col("place").alias(s), F.col("street").alias(f"{s}_street"), F.col("sound").alias(f"{s}_sound"))
    x = side(left, "l").join(shuffled(side(right, "r")), "k").filter(F.levenshtein("l_sound", "r_sound", 4) >= 0)
    return x.filter((F.col("l_sound") == F.col("r_sound")) | _same_street("l_street", "r_street")).select("l", "r").distinct()


def _cities(every: DataFrame) -> DataFrame:
    """(place, city, places): the city each distinct address names, or those it may inherit.

    ``places`` are the entries that the city's name may mean. A missing city comes from addresses
    of the same building with the same postcode, or else, if that leaves one city only, from those
    in the region named.
    """
    read = cut(_readings(every))
    known, lacking = read.filter("city is not null"), read.filter("city is null")
    by_code = _met(known.withColumn("key", F.col("postcode")).filter("key is not null"), lacking.withColumn("key", F.col("postcode")).filter("key is not null"))
    by_region = _met(known.withColumn("key", F.explode("parents")), lacking.withColumn("key", F.explode("region")))
    of = every.filter("city is not null").select(F.col("place").alias("l"), "city", "places")
    given = lambda met, name: met.join(shuffled(of), "l").groupBy(F.col("r").alias("place")).agg(F.collect_set(F.struct("city", "places")).alias(name))
    both = given(by_code, "code").join(shuffled(given(by_region, "near")), "place", "full_outer")
    one = F.when(F.size(F.array_distinct(F.transform("near", lambda c: c.city))) == 1, F.col("near"))
    inherited = both.select("place", F.explode(F.coalesce("code", one)).alias("c")).select("place", "c.city", F.col("c.places").alias("places"))
    return every.filter("city is not null").select("place", "city", "places").unionByName(inherited)


def same_building(left: DataFrame, right: DataFrame, geo: DataFrame, left_id: str, right_id: str, text_col: str = "address") -> DataFrame:
    """(left_id, right_id) for each pair of records at the same building.

    The same building has the same house number with its letter, the same street with its kind and
    direction, and the same city; units do not matter. Addresses without street and number, null
    and blank ones take no part. Repeated ids count once. Pairs are found between the distinct
    addresses and then given to their records; an address shared by many records is cut into slices.
    """
    a, b, pairs = _matched(left, right, geo, left_id, right_id, text_col)
    size = lambda df, c: df.groupBy(F.col("place").alias(c)).agg(F.count("*").alias("n"))
    first = cut(join_salted(a.select(F.col("place").alias("pl"), F.col("id").alias(left_id)), pairs, "pl", size(a, "pl"), "n", a.count()))
    members = b.select(F.col("place").alias("pr"), F.col("id").alias(right_id))
    out = join_salted(members, first.select("pr", left_id), "pr", size(b, "pr"), "n", b.count())
    return out.select(left_id, right_id).distinct()


def building_links(left: DataFrame, right: DataFrame, geo: DataFrame, left_id: str, right_id: str, text_col: str = "address") -> DataFrame:
    """(side, id, class, links): each record with a street and number, its class of equal addresses and its number of links.

    Records of one class have the same links; ``links`` counts the records of the other side.
    """
    a, b, pairs = _matched(left, right, geo, left_id, right_id, text_col)
    size = lambda df, c: df.groupBy(F.col("place").alias(c)).agg(F.count("*").alias("n"))
    of_left = pairs.join(shuffled(size(b, "pr")), "pr").groupBy(F.col("pl").alias("place")).agg(F.sum("n").alias("links"))
    of_right = pairs.join(shuffled(size(a, "pl")), "pl").groupBy(F.col("pr").alias("place")).agg(F.sum("n").alias("links"))
    told = lambda rows, links, side: join_group_facts(rows.select("id", "place"), size(rows, "place").join(shuffled(links), "place", "left").withColumn("links", F.coalesce("links", F.lit(0))), "place", "n", rows.count()).select(F.lit(side).alias("side"), "id", F.col("place").alias("class"), "links")
    return told(a, of_left, left_id).unionByName(told(b, of_right, right_id))


def _matched(left: DataFrame, right: DataFrame, geo: DataFrame, left_id: str, right_id: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, place) of either side and the pairs (pl, pr) of distinct addresses at one building."""

    def parsed(df: DataFrame, id_col: str) -> DataFrame:
        rows = parse_addresses(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and trim(text) != ''").distinct(), "text", geo)
        rows = rows.select("id", *[f"at.{p}" for p in PARTS]).filter("street is not null and number is not null").distinct()
        return cut(rows.withColumn("place", F.xxhash64(*PARTS)))

    a, b = parsed(left, left_id), parsed(right, right_id)
    one = [F.first(p).alias(p) for p in PARTS]
    every = cut(a.withColumn("is_left", F.lit(True)).unionByName(b.withColumn("is_left", F.lit(False))).groupBy("place").agg(*one, F.max("is_left").alias("in_left"), F.max(~F.col("is_left")).alias("in_right")))
    cities = cut(_cities(every))
    read = _readings(every.drop("places", "region", "parents", "city")).join(shuffled(cities.select("place", "city")), "place").withColumn("key", F.col("city"))
    met = _met(read.filter("in_left"), read.filter("in_right"))
    # two places of one city name are apart until here
    sets = cities.groupBy("place").agg(F.flatten(F.collect_list("places")).alias("ids"))
    of = lambda side: shuffled(sets.select(F.col("place").alias(side), F.col("ids").alias(f"{side}_ids")))
    met = met.join(of("l"), "l").join(of("r"), "r").filter(F.arrays_overlap("l_ids", "r_ids"))
    # without a city to inherit, two addresses with one postcode still are one building
    bare = _readings(every.filter("city is null and postcode is not null")).withColumn("key", F.col("postcode"))
    pairs = met.select("l", "r").unionByName(_met(bare.filter("in_left"), bare.filter("in_right"))).distinct()
    return a.select("id", "place"), b.select("id", "place"), cut(pairs.select(F.col("l").alias("pl"), F.col("r").alias("pr")))
