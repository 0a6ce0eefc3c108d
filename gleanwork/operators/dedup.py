"""First-wins duplicate removal by one key or by several at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleanwork.functions import text as X
from gleanwork.operators.skew import join_group_facts
from gleanwork.session import cut


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; rows of hot keys are pre-aggregated."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_first"))
    return best.select(*keys, *[f"_first.{c}" for c in rest]).select(*df.columns)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order, as an upsert leaves it."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return best.select(*keys, *[f"_last.{c}" for c in rest]).select(*df.columns)


def without_known(df: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Rows of which none of the keys is known yet; null keys stay."""
    for key in keys:
        df = df.join(known.filter(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    return df


def claimed(results: DataFrame, ident: str, order: str, *registries: DataFrame) -> DataFrame:
    """The first row of each ident in the given order, of those idents that no registry (ident) holds."""
    for known in registries:
        results = results.join(known.select(ident).distinct(), ident, "left_anti")
    return first_wins(results, [ident], [order])


def purged(df: DataFrame, key: str, owner: str) -> DataFrame:
    """Without the rows whose key belongs to ``owner``, as in 'owner|rest'."""
    return df.filter(~F.coalesce(F.startswith(F.col(key), F.lit(f"{owner}|")), F.lit(False)))


def record_keys(website: Column, cid: Column, name: Column, emails: Column, phones: Column) -> Column:
    """Array of (rank, kind, key): domain, or the listing id where there is none; name; emails; phones."""
    domain = X.norm_domain(website)
    ident = F.when(domain != "", domain).when(X.text(cid) != "", F.concat(F.lit("cid:"), cid)).otherwise(F.lit(""))
    entry = lambda rank, kind, k: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), k.alias("key"))
    single = F.array(entry(1, "domain", ident), entry(2, "name", X.norm_name(name)))
    many = F.concat(F.transform(emails, lambda e: entry(3, "email", X.norm_email(e))), F.transform(phones, lambda p: entry(4, "phone", X.norm_phone(p))))
    return F.array_distinct(F.filter(F.concat(single, F.coalesce(many, F.array().cast("array<struct<rank:int,kind:string,key:string>>"))), lambda e: e.key != ""))


def greedy_unique(records: DataFrame, seq: str, keys: str) -> DataFrame:
    """(seq, accepted, duplicate_of): in order of ``seq`` a record is accepted if no accepted one has one of its keys.

    ``keys`` is an array of (rank, kind, key). Rejected records keep no keys, so this is not one row
    a key. Records that share no key with another are accepted at once. The others are decided in
    rounds: a record that comes first among the undecided in all its keys is accepted, and undecided
    records that share a key with it are rejected. ``duplicate_of`` is the owner of the first
    matching key by rank. Each round is a map-side aggregated group and two balanced joins; a record
    without keys is accepted. The rounds are as many as the longest chain of records each of which
    depends on the decision about the one before.
    """
    kind = records.schema[seq].dataType.simpleString()
    all_rows = records.select(F.col(seq).alias("seq"), F.col(keys).alias("keys")).filter("seq is not null")
    keyed = cut(all_rows.select("seq", F.explode("keys").alias("k")).select("seq", "k.rank", F.concat_ws("\u0001", "k.kind", "k.key").alias("key")).distinct())
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    left = cut(join_group_facts(keyed, sizes, "key", "n", keyed.count()).drop("n"))
    free = all_rows.select("seq").distinct().join(left.select("seq").distinct(), "seq", "left_anti")
    parts, total = [free.select("seq", F.lit(True).alias("accepted"), F.lit(None).cast(kind).alias("duplicate_of"))], left.count()
    while total:
        heads = left.groupBy("key").agg(F.min("seq").alias("head"), F.count("*").alias("n"))
        seen = cut(join_group_facts(left, heads, "key", "n", total).drop("n"))
        firm = seen.groupBy("seq").agg(F.every(F.col("seq") == F.col("head")).alias("ok")).filter("ok").select("seq")
        led = seen.groupBy("head").agg(F.count("*").alias("n")).join(firm.withColumnRenamed("seq", "head"), "head")
        lost = join_group_facts(seen, led, "head", "n", total).filter("head < seq").groupBy("seq").agg(F.min_by("head", F.struct("rank", "head")).alias("duplicate_of"))
        decided = cut(firm.select("seq", F.lit(True).alias("accepted"), F.lit(None).cast(kind).alias("duplicate_of")).unionByName(lost.select("seq", F.lit(False).alias("accepted"), "duplicate_of")))
        parts.append(decided)
        left = cut(seen.drop("head").join(decided.select("seq"), "seq", "left_anti"))
        total = left.count()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def up_to_target(df: DataFrame, group: list[str], order: str, target: int) -> DataFrame:
    """The first ``target`` rows of each group."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(order))).filter(F.col("_n") <= target).drop("_n")


def merge_missing(a: Column, b: Column, most: int) -> Column:
    """The values of ``a`` and then those of ``b`` it lacks, up to ``most``; what ``a`` has is never cut."""
    first, second = F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))
    return F.slice(F.concat(first, F.array_except(second, first)), 1, F.greatest(F.size(first), F.lit(most)))
