"""Roll-ups of records by category, with totals and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleanwork.functions import text as X
from gleanwork.functions.rules import has


def category_stats(records: DataFrame, group: str = "category") -> DataFrame:
    """Records of each category and those with e-mail, site, phone and address; ``records`` has them as strings."""
    filled = lambda c: F.count_if(has(F.col(c)))
    return records.groupBy(group).agg(F.count("*").alias("records"), filled("email").alias("emails"), filled("website").alias("websites"), filled("phonenumber").alias("phones"), filled("address").alias("addresses"))


def summary_with_total(records: DataFrame, found: DataFrame, group: str = "category") -> DataFrame:
    """A row for each category and one for all, named TOTAL; a null category is named as blank.

    ``found`` has (category, discovered, duplicates, failed_urls), what a collection counted; a
    category without such counts was found as often as it has records.
    """
    stats = category_stats(records.withColumn(group, F.coalesce(group, F.lit(""))), group)
    counted = found.groupBy(F.coalesce(F.col(group), F.lit("")).alias(group)).agg(*[F.sum(c).alias(c) for c in ("discovered", "duplicates", "failed_urls")])
    each = stats.join(counted, group, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    each = each.select(group, F.coalesce("discovered", "records", F.lit(0)).alias("found"), *[zero(c) for c in ("records", "websites", "emails", "phones", "addresses", "duplicates", "failed_urls")])
    measures = [c for c in each.columns if c != group]
    r = each.rollup(group).agg(F.grouping(group).alias("g"), *[F.sum(c).cast("long").alias(c) for c in measures])
    return r.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col(group)).alias(group), *measures)


def key_figures(records: DataFrame, log: DataFrame, target: int) -> DataFrame:
    """(metric, value): the figures of a collection, one a row: records, share of the target, filled fields, sites, searches."""
    n = F.count("*")
    r = records.agg(
        n.alias("records"), F.lit(target).cast("long").alias("target"), (n >= target).cast("long").alias("target_reached"), F.round(F.when(F.lit(target) > 0, 100.0 * n / target).otherwise(100.0), 2).alias("completion_percent"),
        F.count_distinct("category").alias("categories"), *[F.count_if(has(F.col(c))).alias(f"with_{c}") for c in ("email", "phonenumber", "address", "services")], F.count_distinct(X.norm_domain(F.col("website"))).alias("domains"),
    )
    s = log.agg(F.count_distinct(X.norm_query(F.col("query"))).alias("queries"), F.count("*").alias("searches"), F.coalesce(F.sum("credits"), F.lit(0)).alias("credits"))
    row = r.join(F.broadcast(s))
    return row.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in row.columns]), F.array(*[F.col(c).cast("double") for c in row.columns]))).alias("metric", "value"))


def dimension_counts(dimension: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """The dimension with the number of facts of each entry, zero included."""
    counts = facts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return dimension.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def share_of_total(records: DataFrame, group: str = "category") -> DataFrame:
    x = records.groupBy(F.coalesce(F.col(group), F.lit("")).alias(group)).agg(F.count("*").alias("n"))
    return x.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 2))


def audit(records: DataFrame) -> DataFrame:
    """Duplicate domains and names left in a set of records, and the number of distinct domains."""
    x = records.select(X.norm_domain(F.col("website")).alias("d"), X.norm_name(F.col("title")).alias("n"))
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    return x.agg(F.count("*").alias("records"), (F.count(full("d")) - F.count_distinct(full("d"))).alias("duplicate_domains"), (F.count(full("n")) - F.count_distinct(full("n"))).alias("duplicate_names"), F.count_distinct("d").alias("domains"))


def digest(df: DataFrame) -> DataFrame:
    """Number of rows and an order-free digest, to tell whether an output changed."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest"))


def signature_diff(local: DataFrame, saved: DataFrame, key: str, sign: str) -> DataFrame:
    """(key, action): what to upsert and to delete so that ``saved`` equals ``local``."""
    a, b = local.select(key, F.col(sign).alias("_a")), saved.select(key, F.col(sign).alias("_b"))
    both = a.join(b, key, "full_outer")
    action = F.when(F.col("_a").isNull(), "delete").when(F.col("_b").isNull() | (F.col("_a") != F.col("_b")), "upsert")
    return both.select(key, action.alias("action")).filter("action is not null")


def ordered_union(parts: list[DataFrame], key: str) -> DataFrame:
    """The union of the parts, of each key (in any letter case) the row of the earliest part."""
    out = None
    for i, p in enumerate(parts):
        q = p.withColumn("_part", F.lit(i))
        out = q if out is None else out.unionByName(q)
    rest = [c for c in out.columns if c != "_part"]
    best = out.groupBy(F.lower(key).alias("_k")).agg(F.min(F.struct("_part", *rest)).alias("_r"))
    return best.select(*[f"_r.{c}" for c in rest])
