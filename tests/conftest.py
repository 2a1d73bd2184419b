from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mercato.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app_name="mercato-tests", shuffle_partitions=4)
    yield s
    s.stop()


def day(i: int, start=dt.date(2023, 1, 1)) -> dt.datetime:
    d = start + dt.timedelta(days=i)
    return dt.datetime(d.year, d.month, d.day)


@pytest.fixture(scope="session")
def series_df(spark):
    """Factory: consecutive days from 2023-01-01 with the given quantities."""
    def make(values, start=dt.date(2023, 1, 1)):
        rows = [(day(i, start), float(v)) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "order_date timestamp, quantity double")
    return make


ORDERS_SMALL = """sku,quantity,price,customer_id,order_date
cup,12,8.5,M7,2022-05-02
jar,15,20.0,M3,2022-05-03
lid,18,6.25,M9,2022-05-04
mug,21,14.0,M1,2022-05-05
pan,24,31.0,M5,2022-05-06
"""

# one value missing in every column but the item
ORDERS_MISSING = """sku,quantity,price,customer_id,order_date
cup,12,8.5,M7,2022-05-02
jar,,20.0,M3,2022-05-03
lid,18,,M9,2022-05-04
mug,21,14.0,,2022-05-05
pan,24,31.0,M5,
"""

ORDERS_ANOMALY = ORDERS_SMALL + "zip,900,7500.0,M8,2022-05-07\n"

SAMPLE_ORDERS = """sku,quantity,price,customer_id,order_date
TEA,9,4.2,P1,2021-11-03
OIL,5,11.75,P2,2021-11-04
TEA,4,4.2,P1,2021-11-05
NUT,6,7.4,P3,2021-11-06
OIL,2,11.75,P4,2021-11-08
TEA,7,4.2,P2,2021-11-09
NUT,8,7.4,P5,2021-11-11
"""


@pytest.fixture
def csv_file(tmp_path):
    """Factory: write text to a fresh folder and return the folder."""
    counter = {"n": 0}

    def make(text: str, name: str = "upload.csv"):
        counter["n"] += 1
        d = tmp_path / f"u{counter['n']}"
        d.mkdir()
        (d / name).write_text(text)
        return str(d)
    return make
