"""Display text: fixed-point numbers, signed percentages, reason sentences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.numeric import half_up

# Reason sentences of the daily picks and of the buy candidates.
DAILY_REASON = {
    "en": "Turnover {turnover} (top {turnover_top}), 1D return {ret1d} (top {ret1d_top}), base-model signal top {model_top}; "
    "final score {score} [turnover {score_turnover}, return {score_ret1d}, model {score_model}], "
    "max return after buy {max_return} (peak {peak}).",
    "ko": "거래대금 {turnover}(상위 {turnover_top}), 1일 상승률 {ret1d}(상위 {ret1d_top}), 기존 모델 신호 상위 {model_top}; "
    "최종 점수 {score}(거래대금 {score_turnover} + 상승률 {score_ret1d} + 기존모델 {score_model}), "
    "매수 후 최고수익률 {max_return}(고점일 {peak}).",
}
CANDIDATE_REASON = {
    "en": "5D momentum {ret5d}, 1D move {ret1d}, volume {volume}, breakout distance {breakout}, NATR14 {natr}.",
    "ko": "5일 수익률 {ret5d}, 1일 수익률 {ret1d}, 거래량 배수 {volume}, 돌파 강도 {breakout}, 변동성(NATR14) {natr} 기반 신호입니다.",
}
EOK_UNIT = {"en": "eok KRW", "ko": "억"}
EOK = 100_000_000.0
UNKNOWN = "-"


def language(code: str | None) -> str:
    return "en" if code == "en" else "ko"


def known(text: Column) -> Column:
    """Text, or a dash when the number behind it is missing."""
    return F.coalesce(text, F.lit(UNKNOWN))


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text, halves away from zero; null for null."""
    scale = float(10**digits)
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", F.round(x * scale) / scale))


def signed_percent(x: Column, digits: int, plus_zero: bool) -> Column:
    """Fraction as signed percent; whether zero carries a plus differs between the two payloads."""
    percent = x * 100.0
    positive = percent >= 0 if plus_zero else percent > 0
    return known(F.concat(F.when(positive, "+").otherwise(""), fixed(percent, digits), F.lit("%")))


def top_band(share: Column) -> Column:
    """"Top x%" text of a percent rank."""
    percent = F.when(share.isNotNull(), F.greatest(F.lit(0.0), (1.0 - share) * 100.0))
    return known(F.concat(fixed(percent, 1), F.lit("%")))


def eok(x: Column, lang: str) -> Column:
    """Won amount in hundred millions with digit grouping."""
    return known(F.concat(F.format_number(half_up(x / EOK), 0), F.lit(EOK_UNIT[language(lang)])))


def times(x: Column) -> Column:
    return known(F.concat(fixed(x, 1), F.lit("x")))


def fill(template: str, values: dict[str, Column]) -> Column:
    """Template with {names} replaced by text columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])
