from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from voucherlens import schema as S  # noqa: E402
from voucherlens.session import local_session  # noqa: E402
from voucherlens.staging import Stage  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("checkpoints")
    session = local_session(**{"spark.checkpoint.dir": f"file://{folder}"})
    yield session
    session.stop()


@pytest.fixture()
def stage(spark):
    with Stage(spark) as own:
        yield own


def day(n: int = 0) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def money(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


@pytest.fixture()
def invoices(spark):
    """Builds invoices from dicts; what is not given gets a harmless default."""
    def build(*rows: dict):
        full = []
        for i, row in enumerate(rows):
            r = {"invoice_id": f"I{i:03d}", "vendor_id": 1, "category_id": 1,
                 "invoice_date": day(i), "amount": 100, "tax_claimed": 1, "state_code": "07"}
            r.update(row)
            for c in ("amount", "tax_claimed"):
                r[c] = None if r[c] is None else money(r[c])
            full.append(tuple(r[f.name] for f in S.INVOICES.fields))
        return spark.createDataFrame(full, S.INVOICES)
    return build


@pytest.fixture()
def vendors(spark):
    def build(*rows):
        """rows of (vendor_id, state_code)"""
        return spark.createDataFrame(
            [(v, f"Vendor {v}", f"{s}X", "Textiles", s, None) for v, s in rows], S.VENDORS)
    return build


@pytest.fixture()
def categories(spark):
    return spark.createDataFrame(
        [(1, "Textiles", Decimal("5.00"), ""), (2, "Logistics", Decimal("18.00"), "")],
        S.CATEGORIES)


def ids(df) -> list[str]:
    return sorted(r.invoice_id for r in df.select("invoice_id").collect())
