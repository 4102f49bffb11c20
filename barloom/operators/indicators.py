"""Technical indicators that are windows over one ticker's series.

Each function returns a Column (or a dict of them) built on a ``Frames``
object and is selected through it; any number of them keeps one exchange and
one sort. Indicators with a true recurrence live in ``recursive``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import Frames
from barloom.functions.numeric import change, ratio

HUNDRED = 100.0
YEAR_ROOT = 252.0**0.5


# --- relative strength, simple-mean variants -------------------------------


def _gain_loss(f: Frames, x: Column, seed: str) -> tuple[Column, Column]:
    """Upward and downward moves; the first bar is null or zero by ``seed``."""
    move = x - f.lag(x)
    if seed == "zero":
        move = F.coalesce(move, F.lit(0.0))
    return (
        F.when(move > 0, move).when(move.isNotNull(), 0.0),
        F.when(move < 0, -move).when(move.isNotNull(), 0.0),
    )


def _strength(gain: Column, loss: Column) -> Column:
    """100 - 100 / (1 + gain/loss); null when loss is zero."""
    return HUNDRED - HUNDRED / (1.0 + ratio(gain, loss))


def _means(f: Frames, x: Column, n: int, seed: str) -> tuple[Column, Column]:
    gain, loss = _gain_loss(f, x, seed)
    return f.mean(gain, n), f.mean(loss, n)


def rsi_null_seed(f: Frames, x: Column, n: int) -> Column:
    """First move unknown: first value on bar n+1; zero loss gives null."""
    return _strength(*_means(f, x, n, "null"))


def rsi_zero_seed(f: Frames, x: Column, n: int) -> Column:
    """First move zero: first value on bar n; zero loss gives null."""
    return _strength(*_means(f, x, n, "zero"))


def rsi_unguarded(f: Frames, x: Column, n: int) -> Column:
    """As rsi_zero_seed, but zero loss with some gain is 100 (0/0 stays null)."""
    gain, loss = _means(f, x, n, "zero")
    return F.when((loss == 0) & (gain > 0), HUNDRED).otherwise(_strength(gain, loss))


RSI_METHODS = {"null_seed": rsi_null_seed, "zero_seed": rsi_zero_seed, "unguarded": rsi_unguarded}


def rsi(f: Frames, x: Column, n: int, method: str) -> Column:
    """Simple-mean RSI; the variant is always named."""
    return RSI_METHODS[method](f, x, n)


# --- trend ------------------------------------------------------------------


def sma_set(f: Frames, x: Column, lengths=(5, 20, 60, 120), prefix: str = "sma_") -> dict[str, Column]:
    return {f"{prefix}{n}": f.mean(x, n, dense=True) for n in lengths}


def ichimoku_lines(f: Frames, high: Column, low: Column) -> dict[str, Column]:
    def mid(n: int) -> Column:
        return (f.highest(high, n, dense=True) + f.lowest(low, n, dense=True)) / F.lit(2.0)

    return {"its_9": mid(9), "iks_26": mid(26)}


# --- momentum ---------------------------------------------------------------


def stochastic(f: Frames, high: Column, low: Column, close: Column, n=14, smooth=3, d=3) -> dict[str, Column]:
    bottom = f.lowest(low, n, dense=True)
    raw = HUNDRED * ratio(close - bottom, f.highest(high, n, dense=True) - bottom)
    k = f.mean(raw, smooth)
    return {"stoch_k": k, "stoch_d": f.mean(k, d)}


def williams_r(f: Frames, high: Column, low: Column, close: Column, n: int = 14) -> Column:
    top = f.highest(high, n, dense=True)
    return -HUNDRED * ratio(top - close, top - f.lowest(low, n, dense=True))


def rate_of_change(f: Frames, x: Column, n: int = 10) -> Column:
    return HUNDRED * change(x, f.lag(x, n))


def momentum(f: Frames, x: Column, n: int = 10) -> Column:
    return x - f.lag(x, n)


def typical_price(high: Column, low: Column, close: Column) -> Column:
    return (high + low + close) / F.lit(3.0)


def cci(f: Frames, high: Column, low: Column, close: Column, n: int = 14) -> Column:
    """(tp - mean) / (0.015 * mean absolute deviation around that mean)."""
    tp = typical_price(high, low, close)
    mean = f.mean(tp, n, dense=True)
    return ratio(tp - mean, F.lit(0.015) * f.deviation(tp, mean, n))


# --- volatility -------------------------------------------------------------


def bollinger(f: Frames, x: Column, n: int = 20, width: float = 2.0, ddof: int = 0) -> dict[str, Column]:
    """Lower, middle, upper, bandwidth in percent and %B."""
    mid = f.mean(x, n, dense=True)
    spread = F.lit(width) * f.std(x, n, ddof=ddof, dense=True)
    lower, upper = mid - spread, mid + spread
    return {
        f"bbl_{n}": lower,
        f"bbm_{n}": mid,
        f"bbu_{n}": upper,
        f"bbb_{n}": HUNDRED * ratio(upper - lower, mid),
        f"bbp_{n}": ratio(x - lower, upper - lower),
    }


def true_range(f: Frames, high: Column, low: Column, close: Column) -> Column:
    """Largest of the three ranges; the first bar has only high - low."""
    before = f.lag(close)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def realized_vol(f: Frames, log_return: Column, n: int = 20) -> Column:
    return f.std(log_return, n, ddof=1) * F.lit(YEAR_ROOT)


# --- volume -----------------------------------------------------------------


def on_balance_volume(f: Frames, close: Column, volume: Column) -> Column:
    """Running sum of volume signed by the direction of the close; starts at zero."""
    signed = F.signum(F.coalesce(close - f.lag(close), F.lit(0.0))) * volume
    return f.running(F.sum, signed)


def money_flow_index(f: Frames, high: Column, low: Column, close: Column, volume: Column, n: int = 14) -> Column:
    tp = typical_price(high, low, close)
    step = tp - f.lag(tp)
    flow = tp * volume
    up = f.total(F.when(step > 0, flow).when(step.isNotNull(), 0.0), n)
    down = f.total(F.when(step < 0, flow).when(step.isNotNull(), 0.0), n)
    return HUNDRED * ratio(up, up + down)


def chaikin_money_flow(f: Frames, high: Column, low: Column, close: Column, volume: Column, n: int = 20) -> Column:
    place = F.coalesce(ratio((close - low) - (high - close), high - low), F.lit(0.0))
    return ratio(f.total(place * volume, n, dense=True), f.total(volume.cast("double"), n, dense=True))


def vwma(f: Frames, close: Column, volume: Column, n: int = 20) -> Column:
    return ratio(f.total(close * volume, n, dense=True), f.total(volume.cast("double"), n, dense=True))


# --- the whole window half of the indicator set -----------------------------


def window_indicators(bars: DataFrame, *, batches: bool = False, only: list[str] | None = None) -> DataFrame:
    """Bars plus every indicator of the set that needs no recurrence, or those of them that ``only`` names."""
    f = Frames(batches=batches)
    o = {c: F.col(c) for c in ("high", "low", "close", "volume")}
    hlc = (o["high"], o["low"], o["close"])
    columns = {
        **sma_set(f, o["close"]),
        **ichimoku_lines(f, o["high"], o["low"]),
        **stochastic(f, *hlc),
        "cci_14": cci(f, *hlc),
        "roc_10": rate_of_change(f, o["close"]),
        "willr_14": williams_r(f, *hlc),
        "mom_10": momentum(f, o["close"]),
        **bollinger(f, o["close"]),
        "stdev_20": f.std(o["close"], 20, ddof=1, dense=True),
        "obv": on_balance_volume(f, o["close"], o["volume"]),
        "mfi_14": money_flow_index(f, *hlc, o["volume"]),
        "cmf_20": chaikin_money_flow(f, *hlc, o["volume"]),
        "vwma_20": vwma(f, o["close"], o["volume"]),
    }
    return f.select(bars, "*", *[c.alias(name) for name, c in columns.items() if only is None or name in only])
