"""Records that differ only in white space, letter case, punctuation or the order of their parts.

Two saturating Bloom filters (bits hit by one record, bits hit by several) are built per task over
the hashes of the canonical texts and merged, block by block, by saturating addition. A text whose
bits were all hit several times may be repeated and is shuffled for exact grouping; any other text
is certainly unique and is emitted as it is read. The filter goes to every task; a corpus for which
it would be too large is grouped without one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.operators.skew import join_group_facts

#: Apostrophes, hyphens and full stops; between two letters or digits they do not count.
JOINERS = "'’‘ʼ＇`´‛′.．․\\-‐‑‒–−﹣－­"
#: Bits per record, probes, and the size of the filter from 8 KB to 64 MB. It gets fewer bits per record when it is full:
#: unique records are then taken for possible repeats at 0.5 % (16 bits a record), 3 % (8), 15 % (4) or 47 % (2).
BITS_PER_ROW, LEAST_LOG2, MOST_LOG2, PROBES = 16, 16, 29, 3
#: With fewer bits a record than this (beyond 268 million records) the filter says 'maybe' to most, so all are grouped.
LEAST_BITS = 2
BLOCK_LOG2 = 17
#: Hashes a task holds at a time; the parts of the filter it makes of them are merged like those of other tasks.
HELD = 1 << 19
#: Canonical texts above this length are grouped by their SHA-256.
LONG_KEY = 96


def canonical_text(text: Column) -> Column:
    """The words of ``text`` in lower case, sorted, each as often as it occurs; '' without a word."""
    joined = F.regexp_replace(text, rf"(?<=[\p{{L}}\p{{M}}\p{{N}}])[{JOINERS}](?=[\p{{L}}\p{{N}}])", "")
    words = F.regexp_extract_all(F.lower(joined), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))
    return F.array_join(F.array_sort(words), " ")


def _key(canonical: Column) -> Column:
    return F.when(F.length(canonical) <= LONG_KEY, canonical).otherwise(F.concat(F.lit("#"), F.sha2(canonical, 256)))


def filter_log2(rows: int) -> int:
    """Size of the filter for a number of rows, as a power of two bits."""
    return int(min(MOST_LOG2, max(LEAST_LOG2, np.ceil(np.log2(max(1, rows) * BITS_PER_ROW)))))


def _positions(hashes: np.ndarray, log2: int) -> np.ndarray:
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    mask = np.uint64((1 << log2) - 1)
    return np.stack([(h + np.uint64(i) * step) & mask for i in range(PROBES)], axis=1).astype(np.int64)


def worth_filtering(rows: int) -> bool:
    """Whether a filter of the largest size still tells most unique records from repeats."""
    return rows * LEAST_BITS <= 1 << MOST_LOG2


def _build(log2: int):
    """A task's filter in blocks: packed bits for blocks of which much is hit, else the places alone."""
    block = min(BLOCK_LOG2, log2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n >= HELD:
                yield from filled(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from filled(np.concatenate(held))

    def filled(values: np.ndarray) -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(values, return_counts=True)
        at = _positions(values, log2)
        # a place is hit again by two texts, or by one that occurs twice
        places, hits = np.unique(np.concatenate([at.ravel(), at[counts > 1].ravel()]), return_counts=True)
        edges = np.flatnonzero(np.diff(places >> block)) + 1
        for part, n in zip(np.split(places, edges), np.split(hits, edges)):
            if len(part):
                within = (part & ((1 << block) - 1)).astype(np.uint32)
                packed = len(within) * 4 >= (1 << block) // 8
                pack = lambda x: _packed(x, block).tobytes() if packed else x.tobytes()  # noqa: E731, B023
                cols = {"block": pa.array([int(part[0] >> block)], pa.int32()), "packed": [packed], "once": [pack(within)], "again": [pack(within[n > 1])]}
                yield pa.RecordBatch.from_pydict(cols)

    return run


def _packed(places: np.ndarray, block: int) -> np.ndarray:
    bits = np.zeros(1 << block, np.bool_)
    bits[places] = True
    return np.packbits(bits)


def _merge(block: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        once, again = (np.zeros((1 << block) // 8, np.uint8) for _ in range(2))
        for packed, a, b in zip(pdf["packed"], pdf["once"], pdf["again"]):
            a, b = (np.frombuffer(x, np.uint8) if packed else _packed(np.frombuffer(x, np.uint32), block) for x in (a, b))
            again |= b | (once & a)
            once |= a
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "packed": [True], "once": [once.tobytes()], "again": [again.tobytes()]})

    return run


def repeat_filter(hashes: DataFrame, log2: int) -> np.ndarray:
    """The merged filter of repeatedly hit bits, packed; ``hashes`` has one long column.

    Parts of a block are merged in groups of about a hundred first, so that no task merges all of
    them. Returned to the driver: 2^log2 bits, at most 64 MB.
    """
    schema = "block int, packed boolean, once binary, again binary"
    block = min(BLOCK_LOG2, log2)
    parts = hashes.mapInArrow(_build(log2), schema)
    groups = parts.withColumn("part", F.spark_partition_id() % 128).groupBy("block", "part").applyInPandas(_merge(block), schema)
    merged = groups.groupBy("block").applyInPandas(_merge(block), schema)
    size = (1 << block) // 8
    bits = np.zeros((1 << log2) // 8, np.uint8)
    for row in merged.select("block", "again").toLocalIterator():
        bits[row[0] * size : (row[0] + 1) * size] = np.frombuffer(row[1], np.uint8)
    return bits


def _flagged(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), canonical_text(F.col(text_col)).alias("canonical")).filter("canonical != '' and id is not null")
    rows = rows.select("id", _key(F.col("canonical")).alias("key"), F.xxhash64("canonical").alias("h"))
    total = df.count()
    if not worth_filtering(total):
        return rows.withColumn("repeated", F.lit(True)), total
    log2 = filter_log2(total)
    bits = spark.sparkContext.broadcast(repeat_filter(rows.select("h"), log2))

    @F.pandas_udf("boolean")
    def may_repeat(h: pd.Series) -> pd.Series:
        at = _positions(h.to_numpy(), log2)
        hit = (bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        return pd.Series(hit.all(axis=1))

    return rows.withColumn("repeated", may_repeat("h")), total


def _groups(repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = repeated.select("key", "id").distinct()
    return rows, rows.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))


def format_duplicate_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row (first_id, copies) for each distinct text up to formatting.

    A repeated id counts once. Null texts, texts without a letter or digit and null ids form no
    group. Equal texts share a group whatever their number; the smallest id stands for it. An
    empty table gives no rows; other columns are not read.
    """
    flagged, _ = _flagged(df, id_col, text_col)
    _, groups = _groups(flagged.filter("repeated"))
    alone = flagged.filter("not repeated").select(F.col("id").alias("first_id"), F.lit(1).cast("long").alias("copies"))
    return groups.select("first_id", "copies").unionByName(alone)


def format_duplicate_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(first_id, id) for each record that is not the first of its group; rules as for the groups."""
    flagged, total = _flagged(df, id_col, text_col)
    rows, groups = _groups(flagged.filter("repeated"))
    out = join_group_facts(rows, groups.filter("copies > 1"), "key", "copies", total)
    return out.filter("id != first_id").select("first_id", "id")
