import pytest

from tickerloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("4", 4)


@pytest.fixture
def bars(spark):
    """Builds a bar table from {ticker: closes}; rows are shuffled on purpose."""
    import datetime as dt
    import random

    def build(series, volume=100):
        start = dt.date(2020, 1, 1)
        rows = [
            (start + dt.timedelta(days=i), t, float(c), float(c) + 1, float(c) - 1, float(c), volume)
            for t, closes in series.items()
            for i, c in enumerate(closes)
        ]
        random.Random(7).shuffle(rows)
        return spark.createDataFrame(
            rows,
            "date date, ticker string, open_Price double, high_Price double, low_Price double, "
            "close_Price double, trade_Volume bigint",
        )

    return build
