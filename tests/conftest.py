import datetime as dt

import pytest

from shopgrain.session import local_session
from shopgrain.sources.tables import TRANSACTION_COLUMNS, TRANSACTION_SCHEMA


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", partitions=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s


DEFAULTS = {
    "product_id": "P1", "category": "Electronics", "region": "North", "customer_gender": "Female", "payment_method": "Card",
    "price": 100.0, "discount": 0.0, "quantity": 1, "total_amount": 100.0, "shipping_cost": 5.0, "profit_margin": 10.0,
    "customer_age": 30, "delivery_time_days": 3, "returned": 0,
}
DAY0 = dt.date(2024, 1, 1)


@pytest.fixture(scope="session")
def make_tx(spark):
    """Rows as dicts; ``day`` counts from 2024-01-01."""

    def build(rows, schema=TRANSACTION_SCHEMA):
        full = []
        for i, r in enumerate(rows):
            r = dict(r)
            day = r.pop("day", 0)
            base = {"order_id": f"O{i:03d}", "customer_id": "C001", "order_date": DAY0 + dt.timedelta(days=day), **DEFAULTS, **r}
            full.append(tuple(base[c] for c in TRANSACTION_COLUMNS))
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
