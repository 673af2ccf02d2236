from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskflow.schema import COLUMNS, REQUEST_DEFAULTS, TXN, TYPE_OF  # noqa: E402
from riskflow.session import STATE_STORE, local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def txns(spark):
    """Build transactions from partial rows; everything not given takes a plain default."""

    def build(rows: list[dict]):
        out = []
        for i, given in enumerate(rows):
            base = dict(REQUEST_DEFAULTS)
            base.update(
                transaction_id=f"T{i:05d}",
                event_timestamp=dt.datetime(2026, 1, 1) + dt.timedelta(hours=i),
                transaction_sequence_id=i,
                customer_id="C1", account_id="A1", card_id="K1", merchant_id="M1", device_id="D1", ip_id="I1",
                amount=100.0, true_fraud_label=0, observed_label=0, fraud_scenario="NONE",
                label_timestamp=dt.datetime(2026, 2, 1),
            )
            base.update(given)
            row = [base[c] for c in COLUMNS]
            out.append(tuple(float(v) if TYPE_OF[c] == "double" and v is not None else v for c, v in zip(COLUMNS, row)))
        return spark.createDataFrame(out, TXN)

    return build
