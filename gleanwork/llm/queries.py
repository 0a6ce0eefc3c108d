"""The queries of the training-data problems, and SQL for those that SQL can check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanwork.llm.address_matching import building_links, same_building
from gleanwork.llm.format_duplicates import format_duplicate_groups, format_duplicate_pairs
from gleanwork.llm.leakage import leaked_items
from gleanwork.llm.linkage import business_links, link_businesses
from gleanwork.llm.name_variants import variant_classes, variant_links
from gleanwork.llm.place_mapping import map_places
from gleanwork.llm.place_oracle import SQL as PLACES_SQL
from gleanwork.llm.subjects import subject_posteriors, subjects_of
from gleanwork.llm.survivors import fused_values, surviving_values
from gleanwork.llm.tokenize import encode_corpus
from gleanwork.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return format_duplicate_pairs(table(spark, sf, "search_log"), "seq", "query").withColumnRenamed("id", "seq").withColumnRenamed("first_id", "first_seq")


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    return format_duplicate_groups(table(spark, sf, "search_log"), "seq", "query").withColumnRenamed("first_id", "first_seq")


def p2_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return link_businesses(table(spark, sf, "places"), table(spark, sf, "partner_places"), table(spark, sf, "geo_list"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_confidence(spark, sf).select("place_key", "listing_id")


def p2_links(spark: SparkSession, sf: str) -> DataFrame:
    return business_links(table(spark, sf, "places"), table(spark, sf, "partner_places"), table(spark, sf, "geo_list"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return surviving_values(table(spark, sf, "extracted"), table(spark, sf, "page_origins"), table(spark, sf, "geo_list"))


def p3_fused(spark: SparkSession, sf: str) -> DataFrame:
    return fused_values(table(spark, sf, "extracted"), table(spark, sf, "page_origins"), table(spark, sf, "geo_list"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return map_places(table(spark, sf, "collect_requests"), table(spark, sf, "geo_list"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return variant_links(table(spark, sf, "places"), table(spark, sf, "extracted"), table(spark, sf, "geo_list"))


def p5_links(spark: SparkSession, sf: str) -> DataFrame:
    return variant_classes(table(spark, sf, "places"), table(spark, sf, "extracted"), table(spark, sf, "geo_list"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_building(table(spark, sf, "places"), table(spark, sf, "extracted"), table(spark, sf, "geo_list"), "place_key", "extract_id")


def p6_links(spark: SparkSession, sf: str) -> DataFrame:
    return building_links(table(spark, sf, "places"), table(spark, sf, "extracted"), table(spark, sf, "geo_list"), "place_key", "extract_id")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return subjects_of(table(spark, sf, "documents"), table(spark, sf, "doc_labels"), table(spark, sf, "benchmark"))


def p9_posteriors(spark: SparkSession, sf: str) -> DataFrame:
    return subject_posteriors(table(spark, sf, "documents"), table(spark, sf, "doc_labels"), table(spark, sf, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_confidence, p2_links, p3_found, p3_fused, p4_found, p5_found, p5_links, p6_found, p6_links, p7_ids, p8_found, p9_found, p9_posteriors)}


_P1_WORDS = r"""words AS (
  SELECT DISTINCT seq, array_to_string(list_sort(regexp_extract_all(lower(
      regexp_replace(regexp_replace(query, '([\p{L}\p{M}\p{N}])[''’‘ʼ＇`´‛′.．․\-‐‑‒–−﹣－]([\p{L}\p{N}])', '\1\2', 'g'),
        '([\p{L}\p{M}\p{N}])[''’‘ʼ＇`´‛′.．․\-‐‑‒–−﹣－]([\p{L}\p{N}])', '\1\2', 'g')), '[\p{L}\p{M}\p{N}]+')), ' ') AS words
  FROM search_log WHERE query IS NOT NULL AND seq IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_P1_WORDS}, firsts AS (SELECT words, min(seq) AS first_seq FROM words WHERE words <> '' GROUP BY words) SELECT first_seq, seq FROM words JOIN firsts USING (words) WHERE seq <> first_seq",
        "p1_groups": f"WITH {_P1_WORDS} SELECT min(seq) AS first_seq, count(*) AS copies FROM words WHERE words <> '' GROUP BY words",
        "p4_found": PLACES_SQL,
    }
