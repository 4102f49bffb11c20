"""The query catalogue: name -> Spark query and, where SQL can say it, its SQL twin."""

from barloom.registry import backtest_queries, indicator_queries, model_queries, series_queries, serving_queries, source_queries
from barloom.registry.base import Query

MODULES = [series_queries, indicator_queries, model_queries, backtest_queries, serving_queries, source_queries]


def catalogue() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in MODULES:
        clash = out.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        out.update(module.QUERIES)
    return out
