"""Rules that look at events one after another, folded in order without holding a group in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the adaptive rate: floor, ceiling (where it starts), cut on a refusal, gain for that many successes.
FLOOR, CEILING, CUT, GAIN, STEADY = 1.0, 8.0, 0.7, 0.5, 10


def fold(df: DataFrame, group: str, order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], object], out: str, kind: str) -> DataFrame:
    """``df`` with a column ``out``: what ``step`` returns for each row, in order within its group.

    Rows are shuffled by group and sorted; batches stream through with one state at a time. The
    rule is sequential, so a group stays in one task, but never in memory as a whole.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), {}
        for batch in batches:
            said = []
            for row in (dict(zip(batch.columns, values)) for values in batch.itertuples(index=False, name=None)):
                if row[group] != key:
                    key, state = row[group], start()
                said.append(step(state, row))
            yield batch.assign(**{out: said})

    return df.filter(F.col(group).isNotNull()).repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, schema)


def rate_limited(hits: DataFrame, limit: int, seconds: int = 60, group: str = "client") -> DataFrame:
    """``hits`` (group, at in seconds, seq) with ``allowed``: two-bucket sliding limit; refused hits do not count."""

    def step(s: dict, row: dict) -> bool:
        bucket = int(row["at"] // seconds)
        if bucket != s["bucket"]:
            s["before"], s["now"] = (s["now"] if bucket == s["bucket"] + 1 else 0), 0
            s["bucket"] = bucket
        part = row["at"] % seconds / seconds
        allowed = s["before"] * (1 - part) + s["now"] < limit
        s["now"] += allowed
        return bool(allowed)

    return fold(hits, group, ["at", "seq"], lambda: {"bucket": -2, "before": 0, "now": 0}, step, "allowed", "boolean")


def adaptive_rate(calls: DataFrame, group: str = "source", ceiling: float = CEILING) -> DataFrame:
    """``calls`` (group, seq, status) with ``rate``: starts at the ceiling, cut on refusals, raised after ten successes in a row below it."""

    def step(s: dict, row: dict) -> float:
        if row["status"] == "ok":
            s["ok"] += 1
            if s["ok"] >= STEADY and s["rate"] < ceiling:
                s["ok"], s["rate"] = 0, min(ceiling, s["rate"] + GAIN)
        else:
            s["ok"], s["rate"] = 0, max(FLOOR, s["rate"] * CUT)
        return s["rate"]

    return fold(calls, group, ["seq"], lambda: {"ok": 0, "rate": ceiling}, step, "rate", "double")
