"""Ranks and row numbers that never need a whole group in one task.

Ranks: groups of more than ``slot_rows`` rows are cut at their own approximate
quantiles. A border value is a slot of its own, so no run of equal values
crosses a border, and a value that a large share of the group repeats -- which
is certain to be a border -- is never sorted: its rows are dealt over salts.
Each such group carries a ladder along: its borders, and for every slot the
rows in it and before it. Slots are then ranked by themselves, and the ladder
lifts their ranks to those of the group. Groups that need no cut have no
ladder and are ranked whole. Numbers: rows are range-sorted, and every sorted
partition adds the count of those before it.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.quantiles import add_edges_passed, even_steps
from barloom.session import materialize, staged

SLOT_ROWS = 1_000_000  # rows that one slot is meant to hold
MAX_BORDERS = 1024
SALTS = 32


def _borders(df: DataFrame, keys: list[str], values: list[str], slot_rows: int) -> DataFrame:
    """(keys, borders of each value column) of the groups with more than ``slot_rows`` rows, as a written table.

    Written, because all that follows must agree on the borders, and
    approximate quantiles depend on the order in which summaries are merged.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > slot_rows)
    steps = even_steps(MAX_BORDERS)
    summaries = df.join(sizes, keys).groupBy(*keys, "_n").agg(
        *[F.percentile_approx(v, steps, F.lit(4 * MAX_BORDERS)).alias(v) for v in values]
    )
    wanted = F.least(F.lit(MAX_BORDERS), F.ceil(2 * F.col("_n") / slot_rows))
    step = F.greatest(F.lit(1), F.floor(F.lit(MAX_BORDERS) / wanted)).cast("int")
    thinned = [F.array_distinct(F.filter(v, lambda _, i: i % F.col("_step") == 0)).alias(v) for v in values]
    return staged(summaries.withColumn("_step", step).select(*keys, *thinned))


def _add_slots(df: DataFrame, borders: dict[str, Column]) -> DataFrame:
    """``df`` with _slot<value> for each value column: 2a above a borders, 2a + 1 on border number a."""
    df = add_edges_passed(df, {f"_slot{v}": (F.col(v), own) for v, own in borders.items()}, MAX_BORDERS, below=True)
    slots = {}
    for v, own in borders.items():
        passed = F.col(f"_slot{v}")
        on_border = F.coalesce(F.get(own, passed) == F.col(v), F.lit(False))
        slots[f"_slot{v}"] = F.when(F.col(v).isNotNull(), 2 * passed + on_border.cast("int"))
    return df.withColumns(slots)


def _ladders(df: DataFrame, keys: list[str], values: list[str], slot_rows: int) -> DataFrame:
    """(keys, one struct of borders, rows in and before each slot, and size per value column), as a written table.

    One row per large group, at most 2 * MAX_BORDERS + 1 slots a column.
    """
    borders = _borders(df, keys, values, slot_rows)
    cut = [F.col(v).alias(f"_b{i}") for i, v in enumerate(values)]
    placed = _add_slots(df.join(borders.select(*keys, *cut), keys), {v: F.col(f"_b{i}") for i, v in enumerate(values)})
    items = [F.struct(F.lit(i).alias("i"), F.col(f"_slot{v}").alias("slot")) for i, v in enumerate(values)]
    counts = (
        placed.select(*keys, F.explode(F.array(*items)).alias("_s"))
        .where("_s.slot IS NOT NULL")
        .groupBy(*keys, "_s.i", "_s.slot")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_slot = Window.partitionBy(*keys, "i").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(by_slot), F.lit(0)))
    rungs = counts.groupBy(*keys).pivot("i", list(range(len(values)))).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", F.struct("before", "n")))).alias("slots"),
        F.sum("n").alias("size"),
    )
    every = F.sequence(F.lit(0), F.lit(2 * MAX_BORDERS + 1))

    def rung(column: str):
        return lambda slot: F.col(column)[slot]

    ladder = [
        F.struct(
            F.col(v).alias("borders"), F.transform(every, rung(f"{i}_slots")).alias("slots"), F.col(f"{i}_size").alias("size")
        ).alias(v)
        for i, v in enumerate(values)
    ]
    return staged(borders.join(rungs, keys).select(*keys, F.struct(*ladder).alias("_ladder")))


def percent_ranks(
    df: DataFrame,
    keys: list[str],
    columns: dict[str, str],
    *,
    nulls: str,
    ascending: bool = True,
    slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """Average-tie percent rank of each ``columns[name]`` inside its group, as ``name``.

    nulls="lowest": nulls rank below everything and count in the divisor.
    nulls="keep": nulls stay null and do not count.
    ``df`` is written out once, and all columns are ranked from that table.
    """
    lowest = {"lowest": True, "keep": False}[nulls]
    sign = 1.0 if ascending else -1.0
    signed = {name: F.col(column).cast("double") * F.lit(sign) for name, column in columns.items()}
    values = {name: f"_x{i}" for i, name in enumerate(columns)}
    keyed = staged(
        df.select("*", *[(F.coalesce(x, F.lit(float("-inf"))) if lowest else x).alias(values[name]) for name, x in signed.items()])
    )
    ladders = _ladders(keyed.select(*keys, *values.values()), keys, list(values.values()), slot_rows)
    out = df.columns + [name for name in columns if name not in df.columns]
    whole = _rank_whole(keyed.join(ladders, keys, "left_anti"), keys, values)
    by_slots = _rank_slots(keyed.join(ladders, keys), keys, values)
    return whole.select(*out).unionByName(by_slots.select(*out))


def _rank_whole(df: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    group = Window.partitionBy(*keys)
    for name, value in values.items():
        ordered = group.orderBy(F.col(value).asc_nulls_last())
        peers = ordered.rangeBetween(Window.currentRow, Window.currentRow)
        rank = F.rank().over(ordered) + (F.count(value).over(peers) - 1) / F.lit(2.0)
        df = df.withColumn(name, F.when(F.col(value).isNotNull(), rank / F.count(value).over(group)))
    return df


def _rank_slots(df: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    # the numbers taken from the ladder travel with a row, the ladder itself stays behind
    df = _add_slots(df, {value: F.col("_ladder")[value]["borders"] for value in values.values()})
    df = df.withColumns(
        {f"_rung{value}": F.get(F.col("_ladder")[value]["slots"], F.col(f"_slot{value}")) for value in values.values()}
        | {f"_size{value}": F.col("_ladder")[value]["size"] for value in values.values()}
    ).drop("_ladder")
    for name, value in values.items():
        slot, rung = F.col(f"_slot{value}"), F.col(f"_rung{value}")
        # one value, or null: nothing to order
        pure = slot.isNull() | (slot % 2 == 1)
        df = df.withColumn("_salt", F.when(pure, (F.rand(17) * SALTS).cast("int")).otherwise(0))
        ordered = Window.partitionBy(*keys, slot, "_salt").orderBy(value)
        peers = ordered.rangeBetween(Window.currentRow, Window.currentRow)
        inner = F.rank().over(ordered) + (F.count(F.lit(1)).over(peers) - 1) / F.lit(2.0)
        rank = rung["before"] + F.when(pure, (rung["n"] + 1) / F.lit(2.0)).otherwise(inner)
        df = df.withColumn(name, F.when(F.col(value).isNotNull(), rank / F.col(f"_size{value}")))
    return df


def number_rows(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """1, 2, 3, ... over the whole table in ``order`` (which must be total).

    The input is written once, so that sampling it for the sort does not repeat
    the work behind it, and the sorted rows are checkpointed, so that counting
    and numbering see the same partitions.
    """
    ordered = materialize(staged(df).orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    ordered = ordered.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    # one row per sort partition: as many as the sort has tasks, whatever the data
    parts = sorted(ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    passed = itertools.accumulate([r.n for r in parts], initial=0)
    starts = df.sparkSession.createDataFrame([(r._part, n) for r, n in zip(parts, passed)], "_part long, _start long")
    return ordered.join(starts, "_part").withColumn(out, F.col("_start") + F.col("_at") + 1).drop("_id", "_part", "_at", "_start")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows of each group. Spark cuts to n per group before the shuffle as well."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(ordered)).where(F.col(out) <= n)


def all_of(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions)
