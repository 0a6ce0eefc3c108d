"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on, so at most 1 / HOT_SHARE keys can be hot.
HOT_SHARE = 1 / 2000
#: Tables of more rows are shuffled whatever Spark takes their size to be: it knows a table behind a lineage cut by the size of the
#: compressed files alone, which may be a hundredth of what a broadcast of it would take in the driver.
MOST_GUESSED = 100_000


def shuffled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, to be joined without a broadcast; left to the estimate if ``rows`` are given and few."""
    return df if rows is not None and rows <= MOST_GUESSED else df.hint("merge")


def join_group_facts(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row of facts per ``key``.

    ``groups[count]`` is the number of rows a key has among ``total``. Keys with at least
    ``HOT_SHARE`` of the total are joined by broadcast (there can be no more than
    ``1 / HOT_SHARE`` of them); the others are shuffled. Null keys match nothing.
    """
    least = max(1000.0, total * HOT_SHARE)
    hot = groups.filter(F.col(count) >= least)
    facts = [c for c in groups.columns if c != key]
    marked = rows.join(F.broadcast(hot.select(key, F.struct(*facts).alias("_hot"))), key, "left")
    warm = marked.filter("_hot is not null").select(*rows.columns, "_hot.*")
    cold = marked.filter("_hot is null").drop("_hot").join(shuffled(groups.filter(F.col(count) < least), total), key)
    return warm.unionByName(cold.select(*rows.columns, *facts))


def join_salted(rows: DataFrame, facts: DataFrame, key: str, sizes: DataFrame, size: str, total: int, most: int = 20_000) -> DataFrame:
    """Inner join of ``rows`` with any number of ``facts`` per ``key``; hot keys are cut into a grid of slices.

    ``sizes`` has the number of ``rows`` of each key. A key with at least ``HOT_SHARE`` of the
    ``total`` rows, or of the facts, is cut into slices of about ``most`` rows on either side; each
    slice of rows meets each slice of facts in a task of its own. No more than ``1 / HOT_SHARE``
    keys can be hot on either side, so their list is broadcast. ``facts`` are read three times.
    """
    per_key = facts.groupBy(key).agg(F.count("*").alias("_facts"))
    all_facts = facts.count()
    slices = lambda n: F.ceil(F.col(n) / most).cast("int")
    hot_rows = sizes.filter(F.col(size) >= max(1000.0, total * HOT_SHARE)).select(key, slices(size).alias("_across"))
    hot_facts = per_key.filter(F.col("_facts") >= max(1000.0, all_facts * HOT_SHARE)).select(key, slices("_facts").alias("_down"))
    hot = F.broadcast(hot_rows.join(hot_facts, key, "full_outer").select(key, F.coalesce("_across", F.lit(1)).alias("_across"), F.coalesce("_down", F.lit(1)).alias("_down")).filter("_across > 1 or _down > 1"))
    one, cols = F.lit(1), lambda df: [c for c in df.columns if c != key]

    def cut_up(df: DataFrame, own: str, other: str, mine: str, its: str) -> DataFrame:
        x = df.join(hot, key, "left").withColumn(mine, F.pmod(F.xxhash64(*df.columns), F.coalesce(own, one)).cast("int"))
        return x.withColumn(its, F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1))).select(key, "_x", "_y", *cols(df))

    theirs = shuffled(cut_up(facts, "_down", "_across", "_y", "_x"), max(total, all_facts))
    return cut_up(rows, "_across", "_down", "_x", "_y").join(theirs, [key, "_x", "_y"]).drop("_x", "_y")
