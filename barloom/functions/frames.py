"""Row frames over one ticker's series, with the min-periods rule.

A ticker's series holds one bar per trade date (the readers and the upsert
guarantee it), so the length of a window partition is bounded by the trading
calendar -- about 250 rows a year -- whatever the size of the data set.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.rolling import KERNELS, Roll, add_rolled

# Frames from this length on are rolled in Arrow batches: Spark's own frames visit all their rows anew for every row.
LONG = 8


def _named(x: Column) -> set[str]:
    """Hidden columns that an expression refers to."""
    return set(re.findall(r"_w\d+_", str(x)))


def series(key: str = "ticker", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


@dataclass(frozen=True)
class _Long:
    """A rolled value that may be taken from Arrow batches."""

    x: Column
    roll: Roll


class Frames:
    """Rolling expressions over a series, each computed once.

    Methods return references to hidden columns; ``select`` adds the distinct
    window expressions behind them and then builds the requested columns.
    Spark would evaluate a window expression again for every place it occurs
    in; here a mean used by five indicators is one expression. All of them
    share one partitioning and ordering, hence one exchange and one sort.
    With ``batches``, which pays where there are many, long frames that no
    other window expression builds on are rolled last, together, in Arrow
    batches. What no requested column needs is left out.
    """

    def __init__(self, key: str = "ticker", order: str = "date", *, batches: bool = False):
        self.spec = series(key, order)
        self._batches = batches
        self._known: dict[str, str] = {}
        self._levels: dict[str, tuple[int, Column]] = {}
        self._needs: dict[str, set[str]] = {}
        self._long: dict[str, _Long] = {}

    def once(self, expression: Column) -> Column:
        """Reference to a window expression over ``spec``."""
        text = str(expression)
        if text not in self._known:
            name = f"_w{len(self._known)}_"
            # an expression over other hidden columns is added after them
            self._needs[name] = _named(expression)
            self._known[text] = name
            self._levels[name] = (1 + max((self._levels[n][0] for n in self._needs[name]), default=0), expression)
        return F.col(self._known[text])

    def _needed(self, names: set[str]) -> set[str]:
        """``names`` and all that they are built on."""
        more = set().union(*[self._needs[n] for n in names]) - names
        return self._needed(names | more) if more else names

    def select(self, df: DataFrame, *columns: Column | str) -> DataFrame:
        """``df.select(*columns)`` where columns may hold references of this object; "*" is df's own columns."""
        own = df.columns
        needed = self._needed({n for c in columns if isinstance(c, Column) for n in _named(c)})
        inner = set().union(*[self._needs[n] for n in needed])
        late = {n: self._long[n] for n in self._levels if n in self._long and n in needed - inner}
        bar = self.bar_number() if late else None
        now = [n for n in self._levels if n in needed - set(late)]
        if late and str(bar_name := _named(bar).pop()) not in now:
            now.append(bar_name)
        for level in sorted({self._levels[n][0] for n in now}):
            added = [self._levels[n][1].alias(n) for n in now if self._levels[n][0] == level]
            df = df.select("*", *added)
        if late:
            # the window of the bar number leaves whole series in order in a partition
            df = add_rolled(df, bar_name, {n: (x.x, x.roll) for n, x in late.items()})
        wanted: list[Column | str] = []
        for c in columns:
            wanted.extend(own if isinstance(c, str) and c == "*" else [c])
        return df.select(*wanted)

    def lag(self, x: Column | str, k: int = 1) -> Column:
        return self.once(F.lag(x, k).over(self.spec))

    def lead(self, x: Column | str, k: int = 1) -> Column:
        return self.once(F.lead(x, k).over(self.spec))

    def bar_number(self) -> Column:
        return self.once(F.row_number().over(self.spec))

    def rows(self, agg: Callable[[Column], Column], x: Column, n: int, shift: int = 0) -> Column:
        """``agg`` over the n rows ending ``shift`` rows back, however many there are."""
        return self.once(agg(x).over(self.spec.rowsBetween(-(n - 1) - shift, -shift)))

    def rolling(
        self,
        agg: Callable[[Column], Column],
        x: Column,
        n: int,
        *,
        shift: int = 0,
        dense: bool = False,
        partial: bool = False,
    ) -> Column:
        """``agg`` over a frame, null until the frame holds n non-null values.

        ``dense`` says x has no nulls, so the row number replaces a count over
        the frame; ``partial`` drops the rule (short frames give a value).
        """
        if self._batches and not partial and n >= LONG and agg in KERNELS:
            return self._rolled(agg, x, n, shift, dense)
        value = self.rows(agg, x, n, shift)
        if partial:
            return value
        if dense:
            return F.when(self.bar_number() >= n + shift, value)
        return F.when(self.rows(F.count, x, n, shift) == n, value)

    def _rolled(self, agg: Callable[[Column], Column], x: Column, n: int, shift: int, dense: bool) -> Column:
        frame = self.spec.rowsBetween(-(n - 1) - shift, -shift)
        full = F.row_number().over(self.spec) >= n + shift if dense else F.count(x).over(frame) == n
        reference = self.once(F.when(full, agg(x).over(frame)))
        self._long[_named(reference).pop()] = _Long(x, Roll(KERNELS[agg], n, shift, dense))
        return reference

    def deviation(self, x: Column, mean: Column, n: int) -> Column:
        """Mean absolute deviation of the last n values from their mean, given as well; x has no nulls. Nothing else may build on it."""
        reference = self.rows(F.collect_list, x, n)
        if not self._batches:
            return F.aggregate(reference, F.lit(0.0), lambda acc, v: acc + F.abs(v - mean)) / F.lit(float(n))
        self._long[_named(reference).pop()] = _Long(x, Roll("deviation", n, 0, True))
        return reference

    def mean(self, x: Column, n: int, **kw) -> Column:
        return self.rolling(F.avg, x, n, **kw)

    def total(self, x: Column, n: int, **kw) -> Column:
        return self.rolling(F.sum, x, n, **kw)

    def highest(self, x: Column, n: int, **kw) -> Column:
        return self.rolling(F.max, x, n, **kw)

    def lowest(self, x: Column, n: int, **kw) -> Column:
        return self.rolling(F.min, x, n, **kw)

    def std(self, x: Column, n: int, *, ddof: int, **kw) -> Column:
        """ddof is spelled out at every call: 1 for rolling features, 0 for backtests."""
        return self.rolling({0: F.stddev_pop, 1: F.stddev_samp}[ddof], x, n, **kw)

    def running(self, agg: Callable[[Column], Column], x: Column) -> Column:
        return self.once(agg(x).over(self.spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
