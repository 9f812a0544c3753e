"""Per-key results over keys that hold most rows, by eager aggregation.

Both inputs of a join are pre-aggregated by the join key, the compact states
are joined, counts are multiplied and sums combined algebraically, and the
result is rolled up. No task ever sees the rows of one key in full.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.runtime import Cuts


def compact_state(df: DataFrame, keys: Sequence[str], sums: Sequence[str] = (), mins: Sequence[str] = (), maxs: Sequence[str] = ()) -> DataFrame:
    """rows, sums, minima and maxima per key combination; partial aggregation runs before the shuffle.

    Null keys form one group; null values are skipped, and a key with nulls
    only keeps null (SQL rules). An empty table gives no rows.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in mins], *[F.max(c).alias(c) for c in maxs])


def roll_up(state: DataFrame, keys: Sequence[str], sums: Sequence[str] = (), mins: Sequence[str] = (), maxs: Sequence[str] = ()) -> DataFrame:
    """Totals of a coarser key from compact states."""
    return state.groupBy(*keys).agg(F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in mins], *[F.max(c).alias(c) for c in maxs])


def eager_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    left_groups: Sequence[str] = (),
    right_groups: Sequence[str] = (),
    left_sums: Sequence[str] = (),
    right_sums: Sequence[str] = (),
) -> DataFrame:
    """Aggregate of ``left JOIN right USING (on)`` by the groups, without building the join.

    Output: groups, ``rows`` (join rows) and each sum as over the join. A
    left sum is repeated once per matching right row and the reverse, hence
    sum times the other side's count. Null keys match nothing. Group columns
    of one name on both sides must be renamed first. ``on`` may be among the
    groups. A side that has a column ``rows`` is a compact state: its rows count
    as that many.
    """
    counted = lambda df: F.sum("rows") if "rows" in df.columns else F.count(F.lit(1))
    keys = lambda groups: [on, *[g for g in groups if g != on]]
    l = left.where(F.col(on).isNotNull()).groupBy(*keys(left_groups)).agg(counted(left).alias("_nl"), *[F.sum(c).alias(f"_l_{c}") for c in left_sums])
    r = right.where(F.col(on).isNotNull()).groupBy(*keys(right_groups)).agg(counted(right).alias("_nr"), *[F.sum(c).alias(f"_r_{c}") for c in right_sums])
    j = l.join(r, on)
    return j.groupBy(*dict.fromkeys([*left_groups, *right_groups])).agg(
        F.sum(F.col("_nl") * F.col("_nr")).alias("rows"),
        *[F.sum(F.col(f"_l_{c}") * F.col("_nr")).alias(c) for c in left_sums],
        *[F.sum(F.col(f"_r_{c}") * F.col("_nl")).alias(c) for c in right_sums],
    )


def edge_states(edges: DataFrame) -> DataFrame:
    """Compact states of the edges per (dst, relacao): the grain both totals roll up from."""
    return compact_state(edges, ["dst", "relacao"], ["qt", "valor"], ["ts_min"], ["ts_max"])


def edge_totals(edges: DataFrame, key: str) -> DataFrame:
    """rows, qt, valor, ts_min and ts_max per ``dst`` or ``relacao``."""
    return roll_up(edge_states(edges), [key], ["qt", "valor"], ["ts_min"], ["ts_max"])


def heavy_keys(edges: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that hold at least ``share`` of all rows: key, rows, total.

    The edges are read once, into written compact states. Each key's rows are
    those of the edges joined with the key's vertex (one row per key), by eager
    aggregation over the states; the total is rolled up from them too. A null
    key counts towards the total and is no key; an empty table gives no rows.
    """
    states = Cuts(edges.sparkSession, "states").put(edge_states(edges).select("dst", "relacao", "rows"))
    total = states.agg(F.sum("rows")).first()[0] or 0  # one number
    vertex = states.select(F.col(key)).distinct()
    per_key = eager_join(states, vertex, key, left_groups=[key])
    return per_key.where(F.col("rows") >= F.lit(total) * F.lit(share)).select(key, "rows", F.lit(total).cast("long").alias("total"))
