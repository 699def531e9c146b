from __future__ import annotations

import pytest

from quotemill.plans import catalogue
from tests.sqlcheck import DATA, same

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the given tables aren't here")


@pytest.mark.parametrize("name", [n for n in catalogue.ORACLE_SQL if not n.startswith("stream_")])
def test_query_equals_sql(spark, name):
    same(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["presets_candles", "trades_advanced", "preset_coverage"])
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, str(DATA)).count() > 0


def test_every_kind_of_ranking_comes_out(spark):
    kinds = {r.ranking_type for r in catalogue.QUERIES["ranking_kinds"](spark, str(DATA)).select("ranking_type").distinct().collect()}
    assert kinds == {"GAIN", "LOSS", "VOLATILITY", "VOLUME"}
