"""Which searches to make next: phrases and places scored by what they brought so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleanwork.functions import text as X
from gleanwork.operators.ledger import moving_average, paid
from gleanwork.operators.ranking import numbered

#: Fixed values of the scoring.
UNTRIED, REPEAT, LEAST, FOLLOW_NEW, FOLLOW_RESULTS, PRIOR_RATIO, PRIOR_WEIGHT, EXPLORE, THIN = 0.9, 0.75, 0.06, 0.5, 8, 0.35, 20.0, 3, 5
ORDER_DECAY, FULL_LIST, MOST_PAGES, DEEP_PLACES, DEEP_ORGANIC = 0.002, 8, 3, 5, 3
TIERS = ("base", "relaxed", "expanded", "deep")


def searches(log: DataFrame) -> DataFrame:
    """Paid searches with results: seq, kind, page, credits, results, new_results, phrase and place."""
    q = log.filter(paid() & F.col("query").isNotNull()).withColumn("cell", F.split(X.norm_query(F.col("query")), "@"))
    cols = ["seq", "kind", F.coalesce("page", F.lit(1)).alias("page"), F.coalesce("credits", F.lit(0)).cast("long").alias("credits"), "results", "new_results"]
    return q.select(*cols, F.get("cell", 0).alias("phrase"), F.get("cell", 1).alias("place"))


def cells(log: DataFrame) -> DataFrame:
    """Paid searches by canonical phrase and place: credits, results, new results, last page and its size."""
    q = searches(log)
    return q.groupBy("phrase", "place").agg(F.sum("credits").alias("credits"), F.sum("results").alias("results"), F.sum("new_results").alias("new_results"), F.max("page").alias("last_page"), F.max_by("results", F.struct("page", "seq")).alias("last_size"))


def phrase_quality(log: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """(phrase, quality): smoothed share of new results, weighed by the valid records a credit brings.

    ``valid`` has (seq, valid), the records that searches led to. A phrase of three credits or more
    is weighed by its valid records a credit against those of all phrases, between 0.3 and 1.
    """
    q = searches(log)
    if valid is not None:
        q = q.join(valid.groupBy("seq").agg(F.sum("valid").alias("valid")), "seq", "left")
    else:
        q = q.withColumn("valid", F.lit(None).cast("long"))
    p = q.groupBy("phrase").agg(F.sum("credits").alias("credits"), F.sum(F.coalesce("results", F.lit(0))).alias("results"), F.sum(F.coalesce("new_results", F.lit(0))).alias("new_results"), F.sum(F.coalesce("valid", F.lit(0))).alias("valid"))
    quality = (F.col("new_results") + 2.1) / (F.col("results") + 3)
    if valid is not None:
        overall = p.agg((F.sum("valid") / F.sum("credits")).alias("overall"))
        p = p.join(F.broadcast(overall))
        ratio = (F.col("valid") / F.col("credits")) / F.col("overall")
        quality = quality * F.when((F.col("credits") >= 3) & (F.col("overall") > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.3), ratio))).otherwise(1.0)
    return p.select("phrase", quality.alias("quality"), "credits", "results", "new_results", "valid")


def new_phrases(phrases: DataFrame, known: DataFrame, in_flight: DataFrame | None = None) -> DataFrame:
    """(phrase, quality) of the phrases (phrase, nr) not searched yet: 0.7, less by their order and by what is under way.

    ``in_flight`` has (phrase, searches).
    """
    fresh = phrases.groupBy("phrase").agg(F.min("nr").alias("nr")).join(known.select("phrase"), "phrase", "left_anti")
    busy = F.lit(0)
    if in_flight is not None:
        fresh = fresh.join(in_flight.groupBy("phrase").agg(F.sum("searches").alias("busy")), "phrase", "left")
        busy = F.coalesce("busy", F.lit(0))
    return fresh.select("phrase", ((F.lit(2.1) / 3.0 - ORDER_DECAY * F.col("nr")) * F.pow(F.lit(REPEAT), busy)).alias("quality"))


def place_freshness(log: DataFrame) -> DataFrame:
    """(place, freshness): moving average of the share of new results, less for the repeat. A search without results counts as 0."""
    q = searches(log).filter("results is not null")
    share = F.coalesce(F.try_divide(F.col("new_results"), F.col("results")), F.lit(0.0))
    return moving_average(q, "place", "seq", share).select("place", (F.col("average") * REPEAT).alias("freshness"))


def next_cells(log: DataFrame, n: int = 20, valid: DataFrame | None = None, places: DataFrame | None = None, tier: str = "base") -> DataFrame:
    """The n untried pairs of phrase and place (phrase, place, expected) with the highest expected share of new results.

    Phrases are those of the log; places those of the log and of ``places`` (place), of which the
    never searched ones are worth UNTRIED. In the first tier only pairs worth LEAST count, later
    any. Of pairs worth the same the smaller phrase, then place, goes first.

    A place can only have its best n + t phrases in the answer if t of its pairs were tried, so
    phrases are numbered once and each place is joined with that many numbers, not with all phrases.
    """
    quality = phrase_quality(log, valid).select("phrase", F.round("quality", 6).alias("quality"))
    fresh = place_freshness(log).select("place", F.round("freshness", 6).alias("freshness"))
    tried = searches(log).select("phrase", "place").distinct()
    if places is not None:
        untried = places.select("place").distinct().join(fresh.select("place"), "place", "left_anti")
        fresh = fresh.unionByName(untried.select("place", F.lit(UNTRIED).alias("freshness")))
    ranked = numbered(quality, [F.desc("quality"), F.asc("phrase")], "nr")
    own = tried.groupBy("place").agg(F.count("*").alias("tried"))
    reach = fresh.join(own, "place", "left").withColumn("nr", F.explode(F.sequence(F.lit(1).cast("long"), n + F.coalesce("tried", F.lit(0)))))
    pairs = reach.join(ranked, "nr").withColumn("expected", F.col("quality") * F.col("freshness"))
    if tier == TIERS[0]:
        pairs = pairs.filter(F.col("expected") > LEAST)
    pairs = pairs.join(tried, ["phrase", "place"], "left_anti")
    best = pairs.orderBy(F.desc("expected"), "phrase", "place").limit(n)
    return best.select("phrase", "place", F.round("expected", 6).alias("expected"))


def _with_parent(log: DataFrame) -> DataFrame:
    """Searches with the share of new results on the page before."""
    q = searches(log)
    rate = F.coalesce(F.try_divide(F.col("new_results"), F.col("results")), F.lit(0.0))
    parent = q.filter("results is not null").groupBy("kind", "phrase", "place", (F.col("page") + 1).alias("page")).agg(F.max_by(rate, "seq").alias("parent_rate"))
    return q.join(parent, ["kind", "phrase", "place", "page"], "left")


def follow_up_learning(log: DataFrame) -> DataFrame:
    """One row (expected_new, new_results, measured, ratio): how new a further page is, compared with the page before."""
    q = _with_parent(log).filter((F.col("page") > 1) & F.col("parent_rate").isNotNull() & F.col("results").isNotNull() & (F.col("credits") > 0))
    s = q.agg(F.coalesce(F.sum(F.col("parent_rate") * F.col("results")), F.lit(0.0)).alias("expected_new"), F.coalesce(F.sum("new_results"), F.lit(0)).alias("new_results"), F.count("*").alias("measured"))
    return s.withColumn("ratio", (F.col("new_results") + PRIOR_RATIO * PRIOR_WEIGHT) / (F.col("expected_new") + PRIOR_WEIGHT))


def follow_ups(log: DataFrame) -> DataFrame:
    """(seq, page, expected): next pages worth asking for: full pages of listings of which half was new.

    Their expected share of new results is that of the page times the learned ratio of further
    pages. Pages that were asked for already are left out.
    """
    q = searches(log)
    rate = F.col("new_results") / F.col("results")
    good = q.filter((F.col("kind") == "places") & (F.col("page") < MOST_PAGES) & (F.col("results") >= FOLLOW_RESULTS) & (rate >= FOLLOW_NEW)).withColumn("page", F.col("page") + 1)
    good = good.join(q.filter("kind = 'places'").select("phrase", "place", "page").distinct(), ["phrase", "place", "page"], "left_anti")
    latest = good.groupBy("phrase", "place", "page").agg(F.max_by(F.struct("seq", rate.alias("rate")), "seq").alias("x"))
    return latest.join(F.broadcast(follow_up_learning(log).select("ratio"))).select("x.seq", "page", (F.col("x.rate") * F.col("ratio")).alias("expected"))


def thin_cells(log: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """(phrase, place, expected): cells whose listings are few, worth an organic search that was not made yet."""
    q = searches(log)
    thin = q.filter((F.col("kind") == "places") & (F.col("page") == 1) & (F.col("results") < THIN) & (F.col("credits") > 0)).select("phrase", "place").distinct()
    thin = thin.join(q.filter("kind = 'organic'").select("phrase", "place").distinct(), ["phrase", "place"], "left_anti")
    return thin.join(phrase_quality(log, valid).select("phrase", "quality"), "phrase").select("phrase", "place", (F.col("quality") * UNTRIED * 0.8).alias("expected"))


def deep_requests(log: DataFrame, n: int = 20, organic: bool = True) -> DataFrame:
    """The n further pages (phrase, place, kind, page, new_results) of the cells that brought most new results.

    A cell that was only searched organically is asked for listings, then full pages of listings
    are followed, then it is searched organically, then full organic pages are followed.
    """
    q = searches(log)
    of = lambda kind, value: F.max_by(F.when(F.col("kind") == kind, F.col(value)), F.when(F.col("kind") == kind, F.struct("page", "seq")))
    c = q.groupBy("phrase", "place").agg(
        F.sum(F.coalesce("new_results", F.lit(0))).cast("long").alias("new_results"), F.min("seq").alias("first_seq"), of("places", "page").alias("pp"), of("places", "results").alias("pn"), of("organic", "page").alias("op"), of("organic", "results").alias("on"),
    )
    ask = lambda kind, page: F.struct(F.lit(kind).alias("kind"), page.cast("long").alias("page"))
    nxt = (
        F.when(F.col("pp").isNull(), ask("places", F.lit(1)))
        .when((F.col("pp") < DEEP_PLACES) & (F.col("pn") >= FOLLOW_RESULTS), ask("places", F.col("pp") + 1))
        .when(F.col("op").isNull(), ask("organic", F.lit(1)))
    )
    if organic:
        nxt = nxt.when((F.col("op") < DEEP_ORGANIC) & (F.col("on") >= FULL_LIST), ask("organic", F.col("op") + 1))
    found = c.filter("new_results > 0").withColumn("next", nxt).filter("next is not null")
    return found.orderBy(F.desc("new_results"), "first_seq").limit(n).select("phrase", "place", "next.kind", "next.page", "new_results")


def kind_efficiency(log: DataFrame, valid: DataFrame) -> DataFrame:
    """(kind, credits, valid, valid_per_credit) of the paid searches."""
    q = searches(log).filter("kind is not null").join(valid.groupBy("seq").agg(F.sum("valid").alias("valid")), "seq", "left")
    k = q.groupBy("kind").agg(F.sum("credits").alias("credits"), F.sum(F.coalesce("valid", F.lit(0))).cast("long").alias("valid"))
    return k.withColumn("valid_per_credit", F.round(F.try_divide("valid", "credits"), 2))


def top_phrases(log: DataFrame, valid: DataFrame, n: int = 5) -> DataFrame:
    """The n phrases with most new results, with what they cost and brought."""
    p = phrase_quality(log, valid).drop("quality").withColumn("valid_per_credit", F.round(F.try_divide("valid", "credits"), 2))
    return p.orderBy(F.desc("new_results"), "phrase").limit(n)


def planner_summary(log: DataFrame, valid: DataFrame) -> DataFrame:
    """One row: phrases, places and cells searched, follow-up pages made, their learned ratio, thin cells, valid records a credit."""
    q = searches(log)
    counts = q.agg(F.count_distinct("phrase").alias("phrases"), F.count_distinct("place").alias("places"), F.count_distinct("phrase", "place").alias("cells"), F.count_if(F.col("page") > 1).alias("follow_ups"), F.sum("credits").alias("credits"))
    total = q.join(valid.groupBy("seq").agg(F.sum("valid").alias("valid")), "seq").agg(F.coalesce(F.sum("valid"), F.lit(0)).cast("long").alias("valid"))
    thin = thin_cells(log).agg(F.count("*").alias("thin_cells"))
    out = counts.join(F.broadcast(total)).join(F.broadcast(thin)).join(F.broadcast(follow_up_learning(log).select(F.round("ratio", 3).alias("follow_up_ratio"))))
    return out.withColumn("valid_per_credit", F.round(F.try_divide("valid", "credits"), 2))


def retries(failed: DataFrame, now: Column, most: int = 2, base: float = 5.0) -> DataFrame:
    """``failed`` (..., attempt, failed_at) with ``not_before`` and ``state``: due, waiting, or failed for good after ``most`` attempts."""
    due = F.timestamp_seconds(F.col("failed_at").cast("timestamp").cast("double") + base * F.pow(F.lit(2.0), F.col("attempt")))
    x = failed.withColumn("not_before", F.when(F.col("attempt") < most, due))
    return x.withColumn("state", F.when(F.col("not_before").isNull(), "failed").when(F.col("not_before") <= now, "due").otherwise("waiting"))


def expand_places(geo: DataFrame, country: str, state: str = "", city: str = "") -> DataFrame:
    """(rank, place): where to search for a request, the country or state first, then its cities.

    A city stands alone. The cities of a country come in rounds, the first of each state, then the
    second of each, so that early searches are spread.
    """
    spark = geo.sparkSession
    if city:
        return spark.createDataFrame([(1, ", ".join(x for x in (city, state or country) if x))], "rank int, place string")
    inside = geo.filter((F.lower("country") == country.lower()) & F.col("city").isNotNull())
    if state:
        inside = inside.filter((F.lower("state") == state.lower()) | (F.lower("state_code") == state.lower()))
    depth = F.row_number().over(W.partitionBy("state").orderBy("geo_id"))
    cities = inside.select(F.concat_ws(", ", "city", "state").alias("place"), depth.alias("depth"), "geo_id").dropDuplicates(["place"])
    top = spark.createDataFrame([(", ".join(x for x in (state, country) if x), 0, -1)], "place string, depth int, geo_id long")
    return top.unionByName(cities).select(F.row_number().over(W.orderBy("depth", "geo_id")).alias("rank"), "place")


def expand_all_places(geo: DataFrame) -> DataFrame:
    """(country, rank, place): ``expand_places`` for each country of ``geo`` at once."""
    named = geo.filter("country is not null")
    depth = F.row_number().over(W.partitionBy("country", "state").orderBy("geo_id"))
    cities = named.filter("city is not null").select("country", F.concat_ws(", ", "city", "state").alias("place"), depth.alias("depth"), "geo_id")
    cities = cities.groupBy("country", "place").agg(F.min(F.struct("depth", "geo_id")).alias("at")).select("country", "place", "at.*")
    top = named.select("country").distinct().select("country", F.col("country").alias("place"), F.lit(0).alias("depth"), F.lit(-1).cast("long").alias("geo_id"))
    return top.unionByName(cities).select("country", F.row_number().over(W.partitionBy("country").orderBy("depth", "geo_id")).alias("rank"), "place")


def nearby_places(geo: DataFrame, city: str, state: str = "", country: str = "") -> DataFrame:
    """(rank, place): where to search besides a city: the other cities of its state, then the state.

    Without a state the first one that lists the city is taken; a city that is not listed has none.
    """
    inside = geo.filter("state is not null and city is not null")
    if country:
        inside = inside.filter(F.lower("country") == country.lower())
    home = inside.filter((F.lower("state") == state.lower()) | (F.lower("state_code") == state.lower()) if state else F.lower("city") == city.lower())
    one = home.orderBy("geo_id").limit(1).select("country", "state")
    others = inside.join(F.broadcast(one), ["country", "state"]).filter(F.lower("city") != city.lower()).select(F.concat_ws(", ", "city", "state").alias("place"), "geo_id")
    itself = one.select(F.concat_ws(", ", "state", F.lit(country) if country else F.lit(None).cast("string")).alias("place"), F.lit((1 << 62)).alias("geo_id"))
    return others.unionByName(itself).select(F.row_number().over(W.orderBy("geo_id")).alias("rank"), "place")
