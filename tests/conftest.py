import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, app="barloom-tests")
    yield session
    session.stop()


@pytest.fixture
def make_bars(spark):
    """Bars from {ticker: [close, ...]}; high/low are one above/below, volume 100, one calendar day apart."""
    import datetime as dt

    def build(series, volume=100, start=dt.date(2020, 1, 1)):
        rows = []
        for ticker, closes in series.items():
            for i, c in enumerate(closes):
                high = None if c is None else c + 1.0
                low = None if c is None else c - 1.0
                rows.append((ticker, start + dt.timedelta(days=i), c, high, low, c, volume, c))
        schema = "ticker string, date date, open double, high double, low double, close double, volume long, adj_close double"
        return spark.createDataFrame(rows, schema)

    return build
