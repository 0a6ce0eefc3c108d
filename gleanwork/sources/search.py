"""Recorded search results as tables, and the rules of reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleanwork.functions import text as X
from gleanwork.operators.dedup import first_wins
from gleanwork.operators.skew import join_group_facts

_RESULTS = "array<map<string,string>>"
RESPONSE = f"struct<kind:string,query:string,page:int,places:{_RESULTS},organic:{_RESULTS}>"


def replayed(spark: SparkSession, folder: str) -> DataFrame:
    """The results of recorded responses, JSON files in a folder of any file system: one row a result.

    A file holds {"kind", "query", "page", "places": [...]} or {..., "organic": [...]}; keys that are
    not known are dropped, missing ones are null; a page that is missing is the first. Small files
    share a partition. Broken files give no rows.
    """
    said = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder).select(F.from_json("value", RESPONSE).alias("r"))
    held = F.when(F.size("r.places") > 0, F.col("r.places")).otherwise(F.col("r.organic"))
    each = said.select("r.kind", "r.query", F.coalesce("r.page", F.lit(1)).alias("page"), F.posexplode(held).alias("pos", "x"))
    of = lambda *names: F.coalesce(*[F.try_element_at("x", F.lit(n)) for n in names]).alias(names[-1])
    return each.select("kind", "query", "page", "pos", of("link"), of("title"), of("website"), of("cid"), of("placeId", "placeid"), of("phoneNumber", "phonenumber"), of("address"), of("category"))


def found_in_order(results: DataFrame, most: int = 16) -> DataFrame:
    """(query, link): the distinct http links of each query over all its pages in their order, up to the page on which there are ``most``."""
    links = results.filter(F.col("link").startswith("http")).groupBy("query", "link").agg(F.min(F.struct("page", "pos")).alias("at"))
    upto = F.sum("n").over(W.partitionBy("query").orderBy("page").rowsBetween(W.unboundedPreceding, -1))
    pages = links.groupBy("query", F.col("at.page").alias("page")).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(upto, F.lit(0)))
    return links.withColumn("page", F.col("at.page")).join(pages.filter(F.col("before") < most), ["query", "page"]).select("query", "link", "at")


def organic_links(results: DataFrame, most: int = 10) -> DataFrame:
    """(query, page, pos, link): the distinct http links of each result page in their order, at most ``most``."""
    links = results.filter(F.col("link").startswith("http"))
    first = links.groupBy("query", "page", "link").agg(F.min("pos").alias("pos"))
    w = W.partitionBy("query", "page").orderBy("pos")
    return first.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).select("query", "page", "pos", "link")


def distinct_listings(results: DataFrame, page_keys: list[str], order: str) -> DataFrame:
    """One row for each listing of a page: its cid, else its placeid, else its title; the first in order stays."""
    ident = F.coalesce(*[F.when(X.text(F.col(c)) != "", F.concat(F.lit(f"{c}:"), c)) for c in ("cid", "placeid", "title")], F.lit(""))
    keyed = results.withColumn("_ident", ident)
    return first_wins(keyed, [*page_keys, "_ident"], [order]).drop("_ident")


def full_pages(pages: DataFrame, group: str, page: str, size: str, full: int = 10) -> DataFrame:
    """The pages of each group up to and with the first that is not full, which is found by a map-side aggregate."""
    short = pages.filter(F.col(size) < full).groupBy(group).agg(F.min(page).alias("_short"))
    sizes = pages.groupBy(group).agg(F.count("*").alias("_n"))
    ends = sizes.join(short, group, "left")
    return join_group_facts(pages, ends, group, "_n", pages.count()).filter(F.col("_short").isNull() | (F.col(page) <= F.col("_short"))).select(*pages.columns)


def first_answer(engines: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """The results (engine, query, ...) of each query from the first engine in order that may answer and has any.

    ``engines`` has (engine, nr, failures, failed_at): after each failure an engine rests 30 seconds, twice as long after each further one, ten minutes at most.
    """
    rest = F.least(F.lit(600.0), 30.0 * F.pow(F.lit(2.0), F.col("failures") - 1))
    free = (F.coalesce("failures", F.lit(0)) == 0) | (F.lit(now).cast("timestamp").cast("double") >= F.col("failed_at").cast("timestamp").cast("double") + rest)
    usable = engines.filter(free).select("engine", "nr")
    x = results.join(F.broadcast(usable), "engine")
    first = x.groupBy("query").agg(F.min("nr").alias("nr"))
    return x.join(first, ["query", "nr"]).drop("nr").select(*results.columns)


def resolved(redirects: DataFrame, col: str) -> DataFrame:
    return redirects.withColumn(col, X.unwrap_redirect(F.col(col)))


def allowed_by_robots(pages: DataFrame, robots: DataFrame) -> DataFrame:
    """Pages that no disallow rule of their host's robots table covers; a host without rules allows all.

    ``robots`` has (host, rule), rule being a path prefix; a host that is known to be dead has a
    null rule and allows nothing.
    """
    rules = robots.groupBy(F.lower("host").alias("_host")).agg(F.collect_set("rule").alias("_rules"), F.max(F.col("rule").isNull()).alias("_dead"))
    x = pages.withColumn("_host", X.norm_domain(F.col("url"))).withColumn("_path", F.concat(F.lit("/"), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/?(.*)$", 1)))
    j = x.join(rules, "_host", "left")
    barred = F.coalesce(F.col("_dead"), F.lit(False)) | F.coalesce(F.exists("_rules", lambda r: (r != "") & F.startswith(F.col("_path"), r)), F.lit(False))
    return j.filter(~barred).select(*pages.columns)
