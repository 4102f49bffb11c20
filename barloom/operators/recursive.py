"""Indicators with a true recurrence, in generated plans without Python.

A ticker's sorted rows are one array, as long as the calendar, and an
aggregation over it walks the rows with a state: exponential and Wilder means,
and the parabolic stop. All recurrences asked for share one walk. The array is
walked in blocks, so that appending a row's state copies a block at most; the
state goes on from block to block. Rows keep their order of operations, so the
results do not depend on blocks or partitions to the last bit.

The arrays are walked by interpreted lambdas, which is slow on long tables. With
``batches`` the same steps, in the same order of operations, are taken by Arrow
batches of whole series, all series of a batch at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.frames import series
from barloom.functions.numeric import ratio
from barloom.functions.rolling import OUT_ROWS, whole_series

BLOCK = 64
WALK_ROWS = 200_000  # rows that a task gathers before it walks them
BAR = "_bar"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def none(kind: str) -> Column:
    return F.lit(None).cast(kind)


# --- values of many series at one bar ----------------------------------------------


class Known:
    """Numbers and whether each is known; arithmetic with an unknown one is unknown. Order and ties are Spark's: NaN is the largest."""

    __slots__ = ("v", "k")

    def __init__(self, v: np.ndarray, k: np.ndarray):
        self.v, self.k = v, k

    def __add__(self, other: "Known") -> "Known":
        return Known(self.v + other.v, self.k & other.k)

    def __sub__(self, other: "Known") -> "Known":
        return Known(self.v - other.v, self.k & other.k)

    def __mul__(self, other: "Known | float") -> "Known":
        return Known(self.v * other.v, self.k & other.k) if isinstance(other, Known) else Known(self.v * other, self.k)

    def __abs__(self) -> "Known":
        return Known(np.abs(self.v), self.k)

    def over(self, other: "Known") -> "Known":
        """The quotient; unknown for a zero divisor."""
        return Known(self.v / other.v, self.k & other.k & (other.v != 0.0))

    def above(self, other: "Known") -> np.ndarray:
        """Known to be greater."""
        return self.k & other.k & ((self.v > other.v) | (np.isnan(self.v) & ~np.isnan(other.v)))

    def first(self, n: int) -> "Known":
        return Known(self.v[:n], self.k[:n])

    def set(self, value: "Known") -> None:
        """The first series take new values."""
        self.v[: len(value.v)], self.k[: len(value.v)] = value.v, value.k


def either(which: np.ndarray, a: Known, b: Known) -> Known:
    return Known(np.where(which, a.v, b.v), np.where(which, a.k, b.k))


def least(*values: Known) -> Known:
    """The smallest known one."""
    out = values[0]
    for x in values[1:]:
        out = either(x.k & (~out.k | out.above(x)), x, out)
    return out


def greatest(*values: Known) -> Known:
    out = values[0]
    for x in values[1:]:
        out = either(x.k & (~out.k | x.above(out)), x, out)
    return out


def nothing(n: int) -> Known:
    return Known(np.zeros(n), np.zeros(n, bool))


def always(value: float, n: int) -> Known:
    return Known(np.full(n, value), np.ones(n, bool))


# --- recurrences ----------------------------------------------------------------


@dataclass(frozen=True)
class Mean:
    """An exponential mean, started with the mean of its first ``n`` known inputs, which has no unknown ones after them."""

    n: int
    alpha: float

    kind = "struct<y:double,seen:int,total:double>"
    shown = ("y",)

    def start(self) -> Column:
        return F.struct(none("double").alias("y"), F.lit(0).alias("seen"), F.lit(0.0).alias("total"))

    def step(self, s: Column, x: Column) -> Column:
        def state(y: Column, seen: Column, total: Column) -> Column:
            return F.struct(y.alias("y"), seen.alias("seen"), total.alias("total"))

        started = state(s["y"] * (1.0 - self.alpha) + x * self.alpha, s["seen"], s["total"])
        more, total = s["seen"] + 1, s["total"] + x
        counted = state(F.when(more == self.n, total / float(self.n)), more, total)
        return F.when(s["seen"] >= self.n, started).when(x.isNull(), s).otherwise(counted)

    def begin(self, n: int) -> dict:
        return {"y": nothing(n), "seen": np.zeros(n, np.int64), "total": np.zeros(n)}

    def advance(self, s: dict, x: Known) -> dict:
        """``step`` for the first series of the state, as many as ``x`` has."""
        n = len(x.v)
        y, seen, total = s["y"].first(n), s["seen"][:n], s["total"][:n]
        started = seen >= self.n
        counted = x.k & ~started
        if started.all():
            y = y * (1.0 - self.alpha) + x * self.alpha
        elif counted.any():
            seen[counted] += 1
            total[counted] += x.v[counted]
            full = counted & (seen == self.n)
            y = either(started, y * (1.0 - self.alpha) + x * self.alpha, either(counted, Known(total / float(self.n), full), y))
        else:
            y = either(started, y * (1.0 - self.alpha) + x * self.alpha, y)
        s["y"].set(y)
        return {"y": y}


@dataclass(frozen=True)
class GappedMean:
    """The same over inputs with gaps: an unknown input repeats the mean, and the past loses weight over it as over any row.

    With ``adjust`` the weights seen so far are normalised (and ``n`` is 1);
    without, the past weighs 1 - alpha and the new input alpha.
    """

    n: int
    alpha: float
    adjust: bool = False

    kind = "struct<y:double,seen:int,total:double,weight:double>"
    shown = ("y",)

    def start(self) -> Column:
        return F.struct(none("double").alias("y"), F.lit(0).alias("seen"), F.lit(0.0).alias("total"), F.lit(1.0).alias("weight"))

    def step(self, s: Column, x: Column) -> Column:
        known = x.isNotNull()
        seen = s["seen"] + known.cast("int")
        total = F.when(known & (s["seen"] < self.n), s["total"] + x).otherwise(s["total"])
        faded, fresh = s["weight"] * (1.0 - self.alpha), F.lit(1.0 if self.adjust else self.alpha)
        moved = (faded * s["y"] + fresh * x) / (faded + fresh)
        y = F.when(~known, s["y"]).when(seen > self.n, moved).when(seen == self.n, total / float(self.n))
        grown = F.when(seen > self.n, faded + 1.0).otherwise(1.0) if self.adjust else F.lit(1.0)
        return F.struct(y.alias("y"), seen.alias("seen"), total.alias("total"), F.when(known, grown).otherwise(faded).alias("weight"))

    def begin(self, n: int) -> dict:
        return {"y": nothing(n), "seen": np.zeros(n, np.int64), "total": np.zeros(n), "weight": np.ones(n)}

    def advance(self, s: dict, x: Known) -> dict:
        n = len(x.v)
        y, seen, total, weight = s["y"].first(n), s["seen"][:n], s["total"][:n], s["weight"][:n]
        summed = x.k & (seen < self.n)
        total[summed] += x.v[summed]
        seen += x.k
        faded, fresh = weight * (1.0 - self.alpha), 1.0 if self.adjust else self.alpha
        moved = Known((faded * y.v + fresh * x.v) / (faded + fresh), y.k)
        y = either(~x.k, y, either(seen > self.n, moved, Known(total / float(self.n), seen == self.n)))
        grown = np.where(seen > self.n, faded + 1.0, 1.0) if self.adjust else 1.0
        weight[:] = np.where(x.k, grown, faded)
        s["y"].set(y)
        return {"y": y}


def ema(n: int) -> Mean:
    return Mean(n, 2.0 / (n + 1.0))


def wilder(n: int) -> Mean:
    return Mean(n, 1.0 / n)


@dataclass(frozen=True)
class Stop:
    """Wilder's parabolic stop.

    Bar 1 has none. On bar 2 the trend is up when the high moved at least as
    far up as the low moved down; the stop starts at the opposite extreme of
    bar 1. Later stops move towards the extreme point, never past the two
    previous bars, and flip to the extreme point when touched.
    """

    accel: float = 0.02
    limit: float = 0.2

    kind = "struct<stop:double,extreme:double,accel:double,up:boolean,flipped:double>"
    shown = ("stop", "accel", "up", "flipped")

    def start(self) -> Column:
        fields = {"stop": "double", "extreme": "double", "accel": "double", "up": "boolean", "flipped": "double"}
        return F.struct(*[none(kind).alias(name) for name, kind in fields.items()])

    def step(self, s: Column, row: Column) -> Column:
        def state(stop, extreme, accel, up, flipped) -> Column:
            return F.struct(stop.alias("stop"), extreme.alias("extreme"), accel.alias("accel"), up.alias("up"), flipped.alias("flipped"))

        high, low, step = row["high"], row["low"], F.lit(self.accel)
        rises = high - row["_high"] >= row["_low"] - low
        second = state(F.when(rises, row["_low"]).otherwise(row["_high"]), F.when(rises, high).otherwise(low), step, rises, F.lit(0.0))

        def later(stop: Column) -> Column:
            touched = F.when(s["up"], low < stop).otherwise(high > stop)
            point = F.when(s["up"] != touched, high).otherwise(low)
            further = F.when(s["up"], point > s["extreme"]).otherwise(point < s["extreme"])
            faster = F.least(s["accel"] + step, F.lit(self.limit))
            return (
                F.when(touched, state(s["extreme"], point, step, ~s["up"], F.lit(1.0)))
                .when(further, state(stop, point, faster, s["up"], F.lit(0.0)))
                .otherwise(state(stop, s["extreme"], s["accel"], s["up"], F.lit(0.0)))
            )

        moved = s["stop"] + s["accel"] * (s["extreme"] - s["stop"])
        held = F.when(s["up"], F.least(moved, row["_low"], row["_low2"])).otherwise(F.greatest(moved, row["_high"], row["_high2"]))
        return F.when(row["_high"].isNull(), s).when(s["up"].isNull(), second).otherwise(let(held, later))

    def begin(self, n: int) -> dict:
        return {name: nothing(n) for name in ("stop", "extreme", "accel", "up", "flipped")}

    def advance(self, s: dict, row: dict[str, Known]) -> dict:
        """``up`` and ``flipped`` are 0 or 1."""
        high, low, high1, low1 = (row[c] for c in ("high", "low", "_high", "_low"))
        n = len(high.v)
        was = {name: x.first(n) for name, x in s.items()}
        up, extreme = was["up"].v > 0, was["extreme"]
        step, none, one = always(self.accel, n), always(0.0, n), always(1.0, n)
        moved = was["stop"] + was["accel"] * (extreme - was["stop"])
        stop = either(up, least(moved, low1, row["_low2"]), greatest(moved, high1, row["_high2"]))
        touched = np.where(up, stop.above(low), high.above(stop))
        # an unknown comparison takes the low
        told = stop.k & np.where(up, low.k, high.k)
        point = either(told & (up != touched), high, low)
        further = np.where(up, point.above(extreme), extreme.above(point))
        turned = {"stop": extreme, "extreme": point, "accel": step, "up": Known((~up).astype(float), was["up"].k), "flipped": one}
        went = {"stop": stop, "extreme": point, "accel": least(was["accel"] + step, always(self.limit, n)), "up": was["up"], "flipped": none}
        stayed = {"stop": stop, "extreme": extreme, "accel": was["accel"], "up": was["up"], "flipped": none}
        out = {name: either(touched, turned[name], either(further, went[name], stayed[name])) for name in s}
        if not was["up"].k.all():
            gain, loss = high - high1, low1 - low
            known = gain.k & loss.k
            rises = known & ~loss.above(gain)
            second = {
                "stop": either(rises, low1, high1), "extreme": either(rises, high, low), "accel": step,
                "up": Known(rises.astype(float), known), "flipped": none,
            }
            out = {name: either(was["up"].k, out[name], second[name]) for name in s}
        if not high1.k.all():
            out = {name: either(high1.k, out[name], was[name]) for name in s}
        for name, x in out.items():
            s[name].set(x)
        return out


Recurrence = Mean | GappedMean | Stop
# the input of a recurrence, from the row and the new states of earlier stages
Input = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Family:
    """Recurrences in two stages (the second sees the new states of the first), and what they give. Inputs take columns or ``Known`` values."""

    first: dict[str, tuple[Recurrence, Input]]
    second: dict[str, tuple[Recurrence, Input]]
    outputs: dict[str, Callable[[Column], Column]]


def _column(name: str) -> Input:
    return lambda row, new: row[name]


def _y(name: str) -> Callable[[Column], Column]:
    return lambda s: s[name]["y"]


def _over(a, b):
    return a.over(b) if isinstance(a, Known) else ratio(a, b)


def _size(x):
    return abs(x) if isinstance(x, Known) else F.abs(x)


def _macd(mean: Callable[[int], Recurrence]) -> Family:
    def line(s: Column) -> Column:
        return s["fast"]["y"] - s["slow"]["y"]

    return Family(
        {"fast": (mean(12), _column("close")), "slow": (mean(26), _column("close"))},
        {"signal": (mean(9), lambda row, new: line(new))},
        {"macd": line, "macd_hist": lambda s: line(s) - s["signal"]["y"], "macd_signal": _y("signal")},
    )


def _directional(n: int = 14) -> Family:
    def along(side: str) -> Callable[[Column], Column]:
        return lambda s: _over(s[side]["y"], s["base"]["y"]) * 100.0

    plus, minus = along("plus"), along("minus")

    def spread(row: Column, new: Column) -> Column:
        # there is no direction while both are zero
        return _over(_size(plus(new) - minus(new)), plus(new) + minus(new)) * 100.0

    return Family(
        {"base": (wilder(n), _column("_tr2")), "plus": (wilder(n), _column("_plus")), "minus": (wilder(n), _column("_minus"))},
        {"adx": (GappedMean(n, 1.0 / n), spread)},
        {f"adx_{n}": _y("adx"), f"dmp_{n}": plus, f"dmn_{n}": minus},
    )


def _rsi(n: int = 14) -> Family:
    def strength(s: Column) -> Column:
        return ratio(s["gain"]["y"], s["gain"]["y"] + s["loss"]["y"]) * 100.0

    return Family({"gain": (wilder(n), _column("_gain")), "loss": (wilder(n), _column("_loss"))}, {}, {f"rsi_{n}": strength})


def _keltner(n: int = 20, width: float = 2.0) -> Family:
    def band(side: float) -> Callable[[Column], Column]:
        return lambda s: s["basis"]["y"] + s["spread"]["y"] * (side * width)

    first = {"basis": (ema(n), _column("close")), "spread": (ema(n), _column("_tr"))}
    return Family(first, {}, {f"kcl_{n}": band(-1.0), f"kcb_{n}": _y("basis"), f"kcu_{n}": band(1.0)})


def _stop() -> Family:
    outputs = {
        "psar_long": lambda s: F.when(s["stop"]["up"], s["stop"]["stop"]),
        "psar_short": lambda s: F.when(~s["stop"]["up"], s["stop"]["stop"]),
        "psar_af": lambda s: s["stop"]["accel"],
        "psar_reversal": lambda s: s["stop"]["flipped"],
    }
    return Family({"stop": (Stop(), lambda row, new: row)}, {}, outputs)


def _with_emas(family: Family) -> Family:
    return Family(family.first, family.second, {"ema_12": _y("fast"), "ema_26": _y("slow"), **family.outputs})


FAMILIES: dict[str, Family] = {
    "macd": _with_emas(_macd(ema)),
    "adx": _directional(),
    "psar": _stop(),
    "rsi": _rsi(),
    "atr": Family({"range": (wilder(14), _column("_tr"))}, {}, {"atr_14": _y("range")}),
    "keltner": _keltner(),
}


# --- the walk -------------------------------------------------------------------


def _inputs(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with what the recurrences read: neighbouring bars, true ranges, moves. All from one window order."""
    order = series()
    before = {"_close": F.lag("close"), "_high": F.lag("high"), "_low": F.lag("low"), "_high2": F.lag("high", 2), "_low2": F.lag("low", 2)}
    df = df.withColumns({name: x.over(order) for name, x in before.items()})
    high, low, close = F.col("high"), F.col("low"), F.col("_close")
    ranges = F.greatest(high - low, F.abs(high - close), F.abs(low - close))
    up, down, move = high - F.col("_high"), F.col("_low") - low, F.col("close") - close
    known = F.col("_high").isNotNull()
    made = {
        "_tr": ranges,
        "_tr2": F.when(close.isNotNull(), ranges),
        "_gain": F.when(close.isNotNull(), F.greatest(move, F.lit(0.0))),
        "_loss": F.when(close.isNotNull(), F.greatest(-move, F.lit(0.0))),
        "_plus": F.when(known, F.when((up > down) & (up > 0), up).otherwise(0.0)),
        "_minus": F.when(known, F.when((down > up) & (down > 0), down).otherwise(0.0)),
    }
    return df.withColumns(made), [*before, *made]


def _walked(df: DataFrame, hidden: list[str], families: dict[str, Family]) -> DataFrame:
    first = {f"{f}_{name}": r for f, family in families.items() for name, (r, _) in family.first.items()}
    second = {f"{f}_{name}": r for f, family in families.items() for name, (r, _) in family.second.items()}
    kind = "struct<" + ",".join(f"{name}:{r.kind}" for name, r in (first | second).items()) + ">"

    def view(state: Column, f: str) -> "_View":
        return _View(state, f)

    def step(state: Column, row: Column) -> Column:
        early = [
            r.step(state[f"{f}_{name}"], given(row, None)).alias(f"{f}_{name}")
            for f, family in families.items()
            for name, (r, given) in family.first.items()
        ]
        if not second:
            return F.struct(*early)

        def late(new: Column) -> Column:
            steps = [
                r.step(state[f"{f}_{name}"], given(row, view(new, f))).alias(f"{f}_{name}")
                for f, family in families.items()
                for name, (r, given) in family.second.items()
            ]
            return F.struct(*[new[name].alias(name) for name in first], *steps)

        return let(F.struct(*early), late)

    def block(done: Column, rows: Column) -> Column:
        states = F.aggregate(rows, F.array(done["last"]), lambda out, row: F.concat(out, F.array(step(F.element_at(out, -1), row))))
        return let(
            states,
            lambda out: F.struct(
                F.concat(done["blocks"], F.array(F.slice(out, 2, BLOCK))).alias("blocks"), F.element_at(out, -1).alias("last")
            ),
        )

    keep = [c for c in df.columns if c not in ("ticker", "date")]
    rows = F.array_sort(F.collect_list(F.struct("date", *keep)))
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size("rows") / BLOCK).cast("int") - 1), lambda i: F.slice("rows", i * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(
        F.array().cast(f"array<array<{kind}>>").alias("blocks"),
        F.struct(*[r.start().alias(name) for name, r in (first | second).items()]).cast(kind).alias("last"),
    )
    walked = df.groupBy("ticker").agg(rows.alias("rows")).withColumn("states", F.flatten(F.aggregate(cut, start, block)["blocks"]))
    paired = walked.select("ticker", F.explode(F.arrays_zip("rows", "states")).alias("p"))
    outputs = [
        given(view(F.col("p.states"), f)).alias(name) for f, family in families.items() for name, given in family.outputs.items()
    ]
    own = [F.col("ticker") if c == "ticker" else F.col(f"p.rows.{c}").alias(c) for c in df.columns if c not in hidden]
    return paired.select(*own, *outputs)


class _View:
    """The states of one family under their own names."""

    def __init__(self, state: Column, family: str):
        self.state, self.family = state, family

    def __getitem__(self, name: str) -> Column:
        return self.state[f"{self.family}_{name}"]


# --- the walk in batches ----------------------------------------------------------


class _Steps:
    """Rows of whole series, put in order of their bar number: those of one bar side by side, longest series first."""

    def __init__(self, bar: np.ndarray):
        first = np.flatnonzero(bar == 0)
        size = np.diff(np.append(first, len(bar)))
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(-size, kind="stable")] = np.arange(len(first))
        # series with a bar of the number
        self.alive = len(first) - np.cumsum(np.bincount(size))[:-1]
        self.begins = np.append(0, np.cumsum(self.alive))
        self.place = self.begins[bar] + np.repeat(rank, size)
        self.series = len(first)

    def given(self, column: pa.ChunkedArray) -> Known:
        x = column.combine_chunks()
        out = Known(np.empty(len(x)), np.empty(len(x), bool))
        out.v[self.place] = x.fill_null(0.0).to_numpy(zero_copy_only=False)
        out.k[self.place] = x.is_valid().to_numpy(zero_copy_only=False)
        return out


def _advanced(steps: _Steps, columns: dict[str, Known], families: dict[str, Family]) -> dict[str, Known]:
    """The shown states of every row, in the order of the steps."""
    plan = [(f, name, r, given) for f, family in families.items() for part in (family.first, family.second) for name, (r, given) in part.items()]
    states = {(f, name): r.begin(steps.series) for f, name, r, _ in plan}
    rows = len(steps.place)
    out = {(f, name, shown): nothing(rows) for f, name, r, _ in plan for shown in r.shown}
    with np.errstate(all="ignore"):
        for low, n in zip(steps.begins.tolist(), steps.alive.tolist()):
            at = slice(low, low + n)
            row = {c: Known(x.v[at], x.k[at]) for c, x in columns.items()}
            new: dict[str, dict] = {f: {} for f in families}
            for f, name, r, given in plan:
                new[f][name] = r.advance(states[f, name], given(row, new[f]))
                for shown in r.shown:
                    y, to = new[f][name][shown], out[f, name, shown]
                    to.v[at], to.k[at] = y.v, y.k
    return {f"{f}_{name}_{shown}": x for (f, name, shown), x in out.items()}


def walk_inputs(bars: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows, numbered from 1, with what ``walked_in_batches`` reads; and the names of the added columns."""
    df, hidden = _inputs(bars)
    return df.withColumn(BAR, F.row_number().over(series())), [*hidden, BAR]


def walked_in_batches(df: DataFrame, hidden: list[str], families: list[str] | None = None) -> DataFrame:
    """``recursive_indicators`` over the rows of ``walk_inputs`` and whatever columns they carry; partitions hold whole series in order."""
    chosen = {name: FAMILIES[name] for name in (FAMILIES if families is None else families)}
    own = [c for c in df.columns if c not in hidden]
    read = ["high", "low", "close", *[c for c in hidden if c != BAR]]
    shown = {f"{f}_{name}_{x}": f"_{f}_{name}_{x}" for f, family in chosen.items() for name, (r, _) in (family.first | family.second).items() for x in r.shown}
    kinds = {name: T.BooleanType() if name.endswith("_up") else T.DoubleType() for name in shown}
    out_type = T.StructType([*df.select(own).schema.fields, *[T.StructField(shown[name], kind) for name, kind in kinds.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bar in whole_series(batches, BAR, WALK_ROWS):
            steps = _Steps(bar)
            states = _advanced(steps, {c: steps.given(table[c].cast(pa.float64())) for c in read}, chosen)
            out = table.select(own)
            for name, x in states.items():
                values = pa.array(x.v[steps.place], pa.float64(), mask=~x.k[steps.place])
                out = out.append_column(shown[name], values.cast(pa.bool_()) if name.endswith("_up") else values)
            yield from out.to_batches(max_chunksize=OUT_ROWS)

    walked = df.mapInArrow(run, out_type)
    outputs = [given(_Shown(f)).alias(name) for f, family in chosen.items() for name, given in family.outputs.items()]
    return walked.select(*own, *outputs)


class _Shown:
    """The shown states of one family, as columns."""

    def __init__(self, at: str):
        self.at = at

    def __getitem__(self, name: str) -> "_Shown | Column":
        inner = f"{self.at}_{name}"
        return _Shown(inner) if self.at in FAMILIES else F.col(f"_{inner}")


def recursive_indicators(bars: DataFrame, families: list[str] | None = None, *, batches: bool = False) -> DataFrame:
    """Bars (and whatever columns they carry) plus the chosen recurrences, in one walk."""
    if batches:
        return walked_in_batches(*walk_inputs(bars), families)
    chosen = {name: FAMILIES[name] for name in (FAMILIES if families is None else families)}
    return _walked(*_inputs(bars), chosen)


def ewm_columns(bars: DataFrame, *, adjust: bool) -> DataFrame:
    """MACD from unseeded exponential means; ``adjust`` normalises the weights seen so far."""
    family = _macd(lambda span: GappedMean(1, 2.0 / (span + 1.0), adjust))
    return _walked(bars, [], {"ewm": family})
