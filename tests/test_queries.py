"""Every registered query of the trajectory engine against its SQL twin."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from strideframe.plans import adapters
from strideframe.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("customer", "orders", "lineitem", "events", "embeddings")


def rows(values):
    clean = [tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else v + 0.0 if isinstance(v, float) else v for v in r) for r in values]
    return sorted(clean, key=lambda r: tuple((v is None, "" if v is None else f"{v!r}") for v in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert got
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(want.columns) == columns
        want = [tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in want[columns].astype(object).itertuples(index=False)]
        assert rows(got) == rows(want)


def test_savitzky_golay_covers_all_rows(spark):
    table = adapters.scalars(spark, SF).select("series", "frame_index", "value").toPandas().sort_values(["series", "frame_index"])
    want = {}
    for series, g in table.groupby("series"):
        v = g["value"].to_numpy(float)
        w = min(5, len(v) - (1 - len(v) % 2))
        for i, f in enumerate(g["frame_index"]):
            start = min(max(i - w // 2, 0), len(v) - w)
            at = np.arange(w) - (i - start)
            want[series, f] = np.polyval(np.polyfit(at, v[start : start + w], 2), 0) if w > 2 else v[i]
    got = {(r["series"], r["frame_index"]): r["smooth"] for r in QUERIES["savitzky_golay"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 0.00051 + 1e-9 * abs(want[k]) for k in want)


def test_object_features_need_no_group_for_each_series(spark):
    assert "FlatMapGroupsInPandas" not in QUERIES["object_features"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_composite_scores_order_the_events_once(spark):
    plan = QUERIES["composite_scores"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange") == 1
