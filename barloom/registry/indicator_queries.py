"""Technical indicators: window forms and recurrences."""

from pyspark.sql import functions as F

from barloom.functions.frames import Frames
from barloom.operators import indicators as ind
from barloom.operators import recursive
from barloom.plans import analytics, technical
from barloom.registry.base import Catalogue, Tables, W, frame, lag, query, r, roll, rounded, rs
from barloom.session import staged_by

QUERIES = Catalogue()


def _window(t: Tables, f: Frames, columns: dict):
    return rounded(f.select(t.bars, "ticker", "date", *[c.alias(n) for n, c in columns.items()]))


def _hlc():
    return F.col("high"), F.col("low"), F.col("close")


MOVES = f"""moves AS (SELECT *, close - {lag('close')} AS d FROM bars)"""


def _rsi_sql(gain: str, loss: str, unguarded: bool = False) -> str:
    g, l = roll("avg", gain, 14), roll("avg", loss, 14)
    plain = f"100 - 100 / (1 + ({g}) / nullif({l}, 0))"
    value = f"CASE WHEN ({l}) = 0 AND ({g}) > 0 THEN 100.0 ELSE {plain} END" if unguarded else plain
    return query(
        f"SELECT ticker, date, {r(value, 'rsi_14')} FROM gl",
        MOVES,
        "gl AS (SELECT *, greatest(d, 0) AS g0, greatest(-d, 0) AS l0, greatest(coalesce(d, 0), 0) AS g1,"
        " greatest(coalesce(-d, 0), 0) AS l1, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS g2,"
        " CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS l2 FROM moves)",
    )


@QUERIES.add("rsi_simple_null_seed", _rsi_sql("g2", "l2"))
def rsi_simple_null_seed(t: Tables):
    f = Frames()
    return _window(t, f, {"rsi_14": ind.rsi(f, F.col("close"), 14, "null_seed")})


@QUERIES.add("rsi_simple_zero_seed", _rsi_sql("g1", "l1"))
def rsi_simple_zero_seed(t: Tables):
    f = Frames()
    return _window(t, f, {"rsi_14": ind.rsi(f, F.col("close"), 14, "zero_seed")})


@QUERIES.add("rsi_unguarded", _rsi_sql("g1", "l1", unguarded=True))
def rsi_unguarded(t: Tables):
    f = Frames()
    return _window(t, f, {"rsi_14": ind.rsi(f, F.col("close"), 14, "unguarded")})


@QUERIES.add(
    "sma_set",
    query(f"SELECT ticker, date, {', '.join(r(roll('avg', 'close', n), f'sma_{n}') for n in (5, 20, 60, 120))} FROM bars"),
)
def sma_set(t: Tables):
    f = Frames()
    return _window(t, f, ind.sma_set(f, F.col("close")))


def _mid(n: int) -> str:
    return f"(({roll('max', 'high', n)}) + ({roll('min', 'low', n)})) / 2"


@QUERIES.add("ichimoku_lines", query(f"SELECT ticker, date, {r(_mid(9), 'its_9')}, {r(_mid(26), 'iks_26')} FROM bars"))
def ichimoku_lines(t: Tables):
    f = Frames()
    return _window(t, f, ind.ichimoku_lines(f, F.col("high"), F.col("low")))


HH, LL = roll("max", "high", 14), roll("min", "low", 14)


@QUERIES.add(
    "stochastic",
    query(
        f"SELECT ticker, date, {rs('stoch_k')}, {r(roll('avg', 'stoch_k', 3), 'stoch_d')} FROM k",
        f"raw AS (SELECT ticker, date, 100 * (close - ({LL})) / nullif(({HH}) - ({LL}), 0) AS x FROM bars)",
        f"k AS (SELECT *, {roll('avg', 'x', 3)} AS stoch_k FROM raw)",
    ),
)
def stochastic(t: Tables):
    f = Frames()
    return _window(t, f, ind.stochastic(f, *_hlc()))


@QUERIES.add(
    "williams_r",
    query(f"SELECT ticker, date, {r(f'-100 * (({HH}) - close) / nullif(({HH}) - ({LL}), 0)', 'willr_14')} FROM bars"),
)
def williams_r(t: Tables):
    f = Frames()
    return _window(t, f, {"willr_14": ind.williams_r(f, *_hlc())})


@QUERIES.add(
    "roc_mom",
    query(
        f"""SELECT ticker, date, {r(f"100 * (close / {lag('close', 10)} - 1)", 'roc_10')},
        {r(f"close - {lag('close', 10)}", 'mom_10')} FROM bars"""
    ),
)
def roc_mom(t: Tables):
    f, x = Frames(), F.col("close")
    return _window(t, f, {"roc_10": ind.rate_of_change(f, x), "mom_10": ind.momentum(f, x)})


@QUERIES.add(
    "cci",
    query(
        f"""SELECT ticker, date, {r('CASE WHEN n >= 14 THEN (tp - m) / nullif(0.015 * list_sum('
        'list_transform(vals, lambda v: abs(v - m))) / 14.0, 0) END', 'cci_14')} FROM s""",
        f"""s AS (SELECT *, row_number() OVER ({W}) AS n, avg(tp) OVER {frame(14)} AS m, list(tp) OVER {frame(14)} AS vals
        FROM (SELECT *, (high + low + close) / 3.0 AS tp FROM bars))""",
    ),
)
def cci(t: Tables):
    f = Frames()
    return _window(t, f, {"cci_14": ind.cci(f, *_hlc())})


def _bands(ddof: str) -> str:
    return f"""b AS (SELECT *, m - s AS bbl_20, m AS bbm_20, m + s AS bbu_20 FROM (SELECT ticker, date, close,
    {roll('avg', 'close', 20)} AS m, 2 * ({roll(ddof, 'close', 20)}) AS s FROM bars))"""


BAND_COLUMNS = f"""{rs('bbl_20 bbm_20 bbu_20')}, {r('100 * (bbu_20 - bbl_20) / nullif(bbm_20, 0)', 'bbb_20')},
    {r('(close - bbl_20) / nullif(bbu_20 - bbl_20, 0)', 'bbp_20')}"""


@QUERIES.add("bollinger", query(f"SELECT ticker, date, {BAND_COLUMNS} FROM b", _bands("stddev_pop")))
def bollinger(t: Tables):
    f = Frames()
    return _window(t, f, ind.bollinger(f, F.col("close")))


@QUERIES.add("bollinger_sample", query(f"SELECT ticker, date, {BAND_COLUMNS} FROM b", _bands("stddev_samp")))
def bollinger_sample(t: Tables):
    f = Frames()
    return _window(t, f, ind.bollinger(f, F.col("close"), ddof=1))


TR = f"""tr AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr
    FROM (SELECT *, {lag('close')} AS pc FROM bars))"""


@QUERIES.add(
    "atr_natr",
    query(
        f"SELECT ticker, date, {rs('tr')}, {r(roll('avg', 'tr', 14), 'atr14')},"
        f" {r('(' + roll('avg', 'tr', 14) + ') / close', 'natr14')} FROM tr",
        TR,
    ),
)
def atr_natr(t: Tables):
    f = Frames()
    tr = ind.true_range(f, *_hlc())
    atr = f.mean(tr, 14)
    return _window(t, f, {"tr": tr, "atr14": atr, "natr14": F.try_divide(atr, F.col("close"))})


@QUERIES.add("stdev", query(f"SELECT ticker, date, {r(roll('stddev_samp', 'close', 20), 'stdev_20')} FROM bars"))
def stdev(t: Tables):
    f = Frames()
    return _window(t, f, {"stdev_20": f.std(F.col("close"), 20, ddof=1, dense=True)})


@QUERIES.add(
    "obv",
    query(f"SELECT ticker, date, {r(f'CAST(sum(sign(coalesce(d, 0)) * volume) OVER ({W}) AS DOUBLE)', 'obv')} FROM moves", MOVES),
)
def obv(t: Tables):
    f = Frames()
    return _window(t, f, {"obv": ind.on_balance_volume(f, F.col("close"), F.col("volume"))})


@QUERIES.add(
    "mfi",
    query(
        f"SELECT ticker, date, {r('100 * up / nullif(up + down, 0)', 'mfi_14')} FROM (SELECT *, {roll('sum', 'p', 14)} AS up,"
        f" {roll('sum', 'n', 14)} AS down FROM flow)",
        f"tp AS (SELECT *, tp - {lag('tp')} AS st FROM (SELECT *, (high + low + close) / 3.0 AS tp FROM bars))",
        "flow AS (SELECT *, CASE WHEN st > 0 THEN tp * volume WHEN st IS NOT NULL THEN 0.0 END AS p,"
        " CASE WHEN st < 0 THEN tp * volume WHEN st IS NOT NULL THEN 0.0 END AS n FROM tp)",
    ),
)
def mfi(t: Tables):
    f = Frames()
    return _window(t, f, {"mfi_14": ind.money_flow_index(f, *_hlc(), F.col("volume"))})


@QUERIES.add(
    "cmf",
    query(
        f"SELECT ticker, date, {r('(' + roll('sum', 'mf', 20) + ') / (' + roll('sum', 'volume', 20) + ')', 'cmf_20')} FROM"
        " (SELECT *, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS mf FROM bars)"
    ),
)
def cmf(t: Tables):
    f = Frames()
    return _window(t, f, {"cmf_20": ind.chaikin_money_flow(f, *_hlc(), F.col("volume"))})


@QUERIES.add(
    "vwma",
    query(
        f"SELECT ticker, date, {r('(' + roll('sum', 'cv', 20) + ') / (' + roll('sum', 'volume', 20) + ')', 'vwma_20')} FROM"
        " (SELECT *, close * volume AS cv FROM bars)"
    ),
)
def vwma(t: Tables):
    f = Frames()
    return _window(t, f, {"vwma_20": ind.vwma(f, F.col("close"), F.col("volume"))})


# --- recurrences -------------------------------------------------------------
# The SQL side walks the bars with a recursive CTE, one bar number per step.

NUMBERED = f"""nb AS MATERIALIZED (SELECT ticker, date, open, high, low, close, rn, pc, ph, pl,
  greatest(high - low, abs(high - pc), abs(low - pc)) AS tr
  FROM (SELECT *, row_number() OVER ({W}) AS rn, {lag('close')} AS pc, {lag('high')} AS ph, {lag('low')} AS pl FROM bars))"""


def smooth(name: str, source: str, x: str, n: int, alpha: str) -> str:
    """Recursive smoothing seeded with the mean of the first n known values of x."""
    return f"""
{name}_in AS MATERIALIZED (SELECT ticker, rn, {x} AS x, count({x}) OVER (PARTITION BY ticker ORDER BY rn) AS k FROM {source}),
{name}_seed AS (SELECT ticker, max(rn) AS rn, avg(x) AS y FROM {name}_in WHERE x IS NOT NULL AND k <= {n}
  GROUP BY ticker HAVING count(*) = {n}),
{name} AS (SELECT ticker, rn, y FROM {name}_seed
  UNION ALL
  SELECT i.ticker, i.rn, {alpha} * i.x + (1 - {alpha}) * s.y FROM {name} s
  JOIN {name}_in i ON i.ticker = s.ticker AND i.rn = s.rn + 1)"""


def _ema(name: str, source: str, x: str, n: int) -> str:
    return smooth(name, source, x, n, f"(2.0::DOUBLE / {n + 1})")


def _wilder(name: str, source: str, x: str, n: int) -> str:
    return smooth(name, source, x, n, f"(1.0::DOUBLE / {n})")


def _recursive(t: Tables, family: str):
    out = recursive.recursive_indicators(t.bars.select("ticker", "date", "high", "low", "close"), [family], batches=True)
    return rounded(out.drop("high", "low", "close"))


@QUERIES.add(
    "ema_macd",
    query(
        f"""SELECT nb.ticker, nb.date, {r('e12.y', 'ema_12')}, {r('e26.y', 'ema_26')}, {r('ml.macd', 'macd')},
        {r('ml.macd - sg.y', 'macd_hist')}, {r('sg.y', 'macd_signal')} FROM nb LEFT JOIN e12 USING (ticker, rn)
        LEFT JOIN e26 USING (ticker, rn) LEFT JOIN ml USING (ticker, rn) LEFT JOIN sg USING (ticker, rn)""",
        NUMBERED,
        _ema("e12", "nb", "close", 12),
        _ema("e26", "nb", "close", 26),
        "ml AS MATERIALIZED (SELECT nb.ticker, nb.rn, e12.y - e26.y AS macd FROM nb LEFT JOIN e12 USING (ticker, rn) LEFT JOIN e26 USING (ticker, rn))",
        _ema("sg", "ml", "macd", 9),
    ),
)
def ema_macd(t: Tables):
    return _recursive(t, "macd")


@QUERIES.add(
    "rsi_wilder",
    query(
        f"""SELECT nb.ticker, nb.date, {r('100 * g.y / nullif(g.y + l.y, 0)', 'rsi_14')} FROM nb
        LEFT JOIN g USING (ticker, rn) LEFT JOIN l USING (ticker, rn)""",
        NUMBERED,
        _wilder("g", "nb", "CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END", 14),
        _wilder("l", "nb", "CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END", 14),
    ),
)
def rsi_wilder(t: Tables):
    return _recursive(t, "rsi")


@QUERIES.add(
    "atr_wilder",
    query(
        f"SELECT nb.ticker, nb.date, {r('a.y', 'atr_14')} FROM nb LEFT JOIN a USING (ticker, rn)",
        NUMBERED,
        _wilder("a", "nb", "tr", 14),
    ),
)
def atr_wilder(t: Tables):
    return _recursive(t, "atr")


@QUERIES.add(
    "keltner",
    query(
        f"""SELECT nb.ticker, nb.date, {r('b.y - 2 * a.y', 'kcl_20')}, {r('b.y', 'kcb_20')}, {r('b.y + 2 * a.y', 'kcu_20')}
        FROM nb LEFT JOIN b USING (ticker, rn) LEFT JOIN a USING (ticker, rn)""",
        NUMBERED,
        _ema("b", "nb", "close", 20),
        _ema("a", "nb", "tr", 20),
    ),
)
def keltner(t: Tables):
    return _recursive(t, "keltner")


@QUERIES.add(
    "adx",
    query(
        f"""SELECT nb.ticker, nb.date, {r('ax.y', 'adx_14')}, {r('dx.dip', 'dmp_14')}, {r('dx.dim', 'dmn_14')}
        FROM nb LEFT JOIN dx USING (ticker, rn) LEFT JOIN ax USING (ticker, rn)""",
        NUMBERED,
        "dm AS MATERIALIZED (SELECT *, CASE WHEN ph IS NULL THEN NULL WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END AS pdm,"
        " CASE WHEN ph IS NULL THEN NULL WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END AS mdm,"
        " CASE WHEN ph IS NOT NULL THEN tr END AS t2 FROM nb)",
        _wilder("pd", "dm", "pdm", 14),
        _wilder("md", "dm", "mdm", 14),
        _wilder("ta", "dm", "t2", 14),
        """dx AS MATERIALIZED (SELECT ticker, rn, dip, dim, 100 * abs(dip - dim) / nullif(dip + dim, 0) AS dx FROM (
        SELECT nb.ticker, nb.rn, 100 * pd.y / nullif(ta.y, 0) AS dip, 100 * md.y / nullif(ta.y, 0) AS dim FROM nb
        LEFT JOIN pd USING (ticker, rn) LEFT JOIN md USING (ticker, rn) LEFT JOIN ta USING (ticker, rn)))""",
        _wilder("ax", "dx", "dx", 14),
    ),
)
def adx(t: Tables):
    return _recursive(t, "adx")


@QUERIES.add(
    "psar",
    query(
        f"""SELECT nb.ticker, nb.date, {r('CASE WHEN up THEN sar END', 'psar_long')}, {r('CASE WHEN NOT up THEN sar END', 'psar_short')},
        {r('af', 'psar_af')}, {r('CAST(flip AS DOUBLE)', 'psar_reversal')} FROM nb LEFT JOIN ps USING (ticker, rn)""",
        NUMBERED,
        """n2 AS MATERIALIZED (SELECT ticker, rn, high, low, ph, pl, lag(ph) OVER (PARTITION BY ticker ORDER BY rn) AS pph,
        lag(pl) OVER (PARTITION BY ticker ORDER BY rn) AS ppl FROM nb)""",
        """ps AS (
        SELECT ticker, rn, high - ph >= pl - low AS up, CASE WHEN high - ph >= pl - low THEN pl ELSE ph END AS sar,
          CASE WHEN high - ph >= pl - low THEN high ELSE low END AS ep, 0.02::DOUBLE AS af, 0 AS flip
        FROM n2 WHERE rn = 2
        UNION ALL
        SELECT ticker, rn, up <> touched, CASE WHEN touched THEN ep ELSE s1 END,
          CASE WHEN touched THEN CASE WHEN up THEN low ELSE high END
               WHEN up THEN greatest(ep, high) ELSE least(ep, low) END,
          CASE WHEN touched THEN 0.02::DOUBLE
               WHEN (up AND high > ep) OR (NOT up AND low < ep) THEN least(af + 0.02::DOUBLE, 0.2::DOUBLE) ELSE af END,
          CAST(touched AS INTEGER)
        FROM (SELECT *, CASE WHEN up THEN low < s1 ELSE high > s1 END AS touched FROM (
          SELECT n.*, p.up, p.ep, p.af, CASE WHEN p.up THEN least(p.sar + p.af * (p.ep - p.sar), n.pl, n.ppl)
            ELSE greatest(p.sar + p.af * (p.ep - p.sar), n.ph, n.pph) END AS s1
          FROM ps p JOIN n2 n ON n.ticker = p.ticker AND n.rn = p.rn + 1)))""",
    ),
)
def psar(t: Tables):
    return _recursive(t, "psar")


def _plain_ewm_sql() -> str:
    def step(name: str, source: str, x: str, span: int) -> str:
        a = f"(2.0::DOUBLE / {span + 1})"
        return f"""{name} AS (SELECT ticker, rn, {x} AS y FROM {source} WHERE rn = 1 UNION ALL
        SELECT i.ticker, i.rn, {a} * i.{x} + (1 - {a}) * s.y FROM {name} s JOIN {source} i ON i.ticker = s.ticker AND i.rn = s.rn + 1)"""

    return query(
        f"""SELECT nb.ticker, nb.date, {r('m.macd', 'macd')}, {r('sg.y', 'macd_signal')}, {r('m.macd - sg.y', 'macd_hist')}
        FROM nb JOIN m USING (ticker, rn) JOIN sg USING (ticker, rn)""",
        NUMBERED,
        step("f12", "nb", "close", 12),
        step("f26", "nb", "close", 26),
        "m AS MATERIALIZED (SELECT ticker, rn, f12.y - f26.y AS macd FROM f12 JOIN f26 USING (ticker, rn))",
        step("sg", "m", "macd", 9),
    )


@QUERIES.add("ewm_macd", _plain_ewm_sql())
def ewm_macd(t: Tables):
    out = recursive.ewm_columns(t.bars.select("ticker", "date", "close"), adjust=False)
    return rounded(out.drop("close"))


def _adjusted_ewm_sql() -> str:
    def step(name: str, source: str, x: str, span: int) -> str:
        d = f"(1 - 2.0::DOUBLE / {span + 1})"
        return f"""{name} AS (SELECT ticker, rn, {x} AS num, 1.0::DOUBLE AS den FROM {source} WHERE rn = 1 UNION ALL
        SELECT i.ticker, i.rn, i.{x} + {d} * s.num, 1 + {d} * s.den FROM {name} s JOIN {source} i ON i.ticker = s.ticker AND i.rn = s.rn + 1)"""

    return query(
        f"""SELECT nb.ticker, nb.date, {r('m.macd', 'macd', 4)}, {r('sg.num / sg.den', 'macd_signal', 4)}, {r('m.macd - sg.num / sg.den', 'macd_hist', 4)}
        FROM nb JOIN m USING (ticker, rn) JOIN sg USING (ticker, rn)""",
        NUMBERED,
        step("f12", "nb", "close", 12),
        step("f26", "nb", "close", 26),
        "m AS MATERIALIZED (SELECT ticker, rn, f12.num / f12.den - f26.num / f26.den AS macd FROM f12 JOIN f26 USING (ticker, rn))",
        step("sg", "m", "macd", 9),
    )


@QUERIES.add("ewm_macd_adjusted", _adjusted_ewm_sql())
def ewm_macd_adjusted(t: Tables):
    out = recursive.ewm_columns(t.bars.select("ticker", "date", "close"), adjust=True)
    return rounded(out.drop("close"), digits=4)


def _all_sql() -> str:
    """The full set is the single queries joined on the bar key."""
    names = ["sma_set", "ichimoku_lines", "stochastic", "cci", "roc_mom", "williams_r", "bollinger", "stdev", "obv", "mfi",
             "cmf", "vwma", "ema_macd", "adx", "psar", "rsi_wilder", "atr_wilder", "keltner"]
    base = query(f"SELECT ticker, date, {rs('open high low close')}, volume FROM bars")
    joins = " ".join(f"JOIN ({QUERIES[n].sql}) AS q_{n} USING (ticker, date)" for n in names)
    return f"SELECT * FROM ({base}) AS base {joins}"


@QUERIES.add("technical_indicators", _all_sql())
def technical_indicators(t: Tables):
    return rounded(technical.technical_indicators(staged_by(t.bars, "ticker"), batches=True))


# --- messy series, one ticker's report -------------------------------------------

NUMBER = "CAST(left(ticker, 6) AS INTEGER)"


def _messy(t: Tables):
    """Bars as text, as a feed may bring them: every 7th ticker without a price, every 11th with a day twice."""
    number = F.left("ticker", F.lit(6)).cast("int")
    close = F.when(number % 7 == 0, F.lit("n/a")).otherwise(F.col("close").cast("string"))
    bars = t.bars.select("ticker", "date", "open", "high", "low", close.alias("close"), F.col("volume").cast("string").alias("volume"))
    return bars.unionByName(bars.where((number % 11 == 0) & (F.dayofmonth("date") == 1)))


@QUERIES.add(
    "indicator_rejects",
    query(
        f"""SELECT ticker, CASE WHEN {NUMBER} % 7 = 0 THEN 'no valid rows after normalization' ELSE 'repeated dates' END AS error,
        CAST(count(*) + count(*) FILTER (WHERE {NUMBER} % 11 = 0 AND day(date) = 1) AS BIGINT) AS rows FROM bars GROUP BY ticker
        HAVING {NUMBER} % 7 = 0 OR ({NUMBER} % 11 = 0 AND count(*) FILTER (WHERE day(date) = 1) > 0)"""
    ),
)
def indicator_rejects(t: Tables):
    return technical.indicators_or_errors(_messy(t))[1]


@QUERIES.add(
    "indicators_beside_rejects",
    f"""SELECT * FROM ({QUERIES['rsi_wilder'].sql}) AS q JOIN ({QUERIES['stochastic'].sql}) AS s USING (ticker, date)
    WHERE {NUMBER} % 7 <> 0 AND ({NUMBER} % 11 <> 0 OR ticker NOT IN (SELECT ticker FROM ({QUERIES['rsi_wilder'].sql}) AS d WHERE day(date) = 1))""",
)
def indicators_beside_rejects(t: Tables):
    shown = ["rsi_14", "stoch_k", "stoch_d"]
    sound, _ = technical.indicators_or_errors(_messy(t), batches=True, only=shown)
    return rounded(sound.select("ticker", "date", *shown))


REPORT = ("000003.KQ", "1996-01-01", "1999-12-31")


def _report_sql(adjusted: bool) -> str:
    """The walk of the unseeded means, and the RSI, over one ticker's slice."""
    walk = QUERIES["ewm_macd_adjusted" if adjusted else "ewm_macd"].sql
    rsi = QUERIES["rsi_unguarded" if adjusted else "rsi_simple_null_seed"].sql
    ticker, start, end = REPORT
    cut = f"lineitem WHERE l_suppkey = {int(ticker[:6])} AND CAST(l_shipdate AS DATE) >= DATE '{start}' AND CAST(l_shipdate AS DATE) < DATE '{end}' AND"
    macd, strength = (sql.replace("lineitem WHERE", cut) for sql in (walk, rsi))
    return f"SELECT * FROM ({macd}) AS m JOIN ({strength}) AS s USING (ticker, date) ORDER BY date"


for _name, _flavour in (("with_indicators", "recursive"), ("with_indicators_adjusted", "adjusted")):

    def _run(t: Tables, flavour: str = _flavour):
        out = analytics.report("with_indicators", t.bars, ticker=REPORT[0], start=REPORT[1], end=REPORT[2], flavour=flavour)
        out = out.select("ticker", "date", "macd", "macd_signal", "macd_hist", "rsi_14")
        return rounded(rounded(out, "macd", "macd_signal", "macd_hist", digits=4), "rsi_14") if flavour == "adjusted" else rounded(out)

    QUERIES.add(_name, _report_sql(_flavour == "adjusted"))(_run)
