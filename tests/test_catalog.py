"""Every query of the engine against its SQL."""

from __future__ import annotations

import pytest
from helpers import DATA, same_as_sql

from tidegrid.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_is_like_its_sql(spark, name):
    same_as_sql(spark, QUERIES[name], ORACLES[name], str(DATA / "sf0.001"))
