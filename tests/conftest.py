import os
import sys
from datetime import date

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tapeloom.session import build_session

    session = build_session(
        "tests", "local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(n: int) -> date:
    return date.fromordinal(date(2020, 1, 1).toordinal() + n)


@pytest.fixture
def bars_of(spark):
    """Bars of one symbol from rows ``(day, open, high, low, close, volume)``."""

    def make(rows, symbol="A"):
        return spark.createDataFrame(
            [(symbol, day(r[0]), *[float(x) for x in r[1:5]], int(r[5])) for r in rows],
            "symbol string, date date, open double, high double, low double, close double, volume bigint",
        )

    return make


@pytest.fixture
def closes_of(bars_of):
    def make(closes, symbol="A"):
        return bars_of([(i, c, c, c, c, 10) for i, c in enumerate(closes)], symbol)

    return make


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).collect()]
