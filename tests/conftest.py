import os
import sys
from datetime import date

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers import the package too
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from salesflow.session import local_session

    session = local_session("4", "salesflow-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def txn_frame(spark):
    """Build transactions from short tuples: (client, day, sku, quantity, usd, maturity, zip)."""
    from salesflow.schemas import LANDING

    def build(rows):
        full = [
            (client, f"TXN_{i:010d}", day, sku, quantity, usd, maturity, code)
            for i, (client, day, sku, quantity, usd, maturity, code) in enumerate(rows)
        ]
        return spark.createDataFrame(full, LANDING)

    return build


@pytest.fixture
def lookup_frames(spark):
    sku = spark.createDataFrame(
        [
            ("SKU_1", "Alpha", "Toys", True),
            ("SKU_2", "Alpha", "Books", False),
            ("SKU_3", "Beta", "Tools", False),
            ("SKU_4", None, None, None),
            ("SKU_5", "Gamma", "Zebra", False),
        ],
        "sku_id string, sku_group string, category string, is_high_priority boolean",
    )
    zips = spark.createDataFrame(
        [
            ("94105", "San Francisco", "CA", True),
            ("10001", "New York", "NY", True),
            ("00000", "Abroad", "CA", False),
            ("55555", None, None, None),
        ],
        "zip_code string, city string, state string, is_us boolean",
    )
    return sku, zips


@pytest.fixture
def lookups(lookup_frames):
    from salesflow.sources.lookups import Lookups

    return Lookups.measured(*lookup_frames)


def rows(frame, *columns):
    """Sorted plain tuples, dates as text."""
    picked = frame.select(*columns) if columns else frame
    plain = [tuple(str(v) if isinstance(v, date) else v for v in r) for r in picked.collect()]
    return sorted(plain, key=repr)
