"""Window filters against loops over stretches."""

import numpy as np
import pytest

from strideframe.operators import kernels

K = ["k"]


def stretches(values):
    start = None
    for i, v in enumerate([*values, None]):
        if v is not None and start is None:
            start = i
        elif v is None and start is not None:
            yield start, i
            start = None


def held(part, i, left, right):
    return [part[min(max(j, 0), len(part) - 1)] for j in range(i - left, i + right + 1)]


def brute(values, size, kind, flavour, order=2):
    out = list(values)
    for a, b in stretches(values):
        part, n = values[a:b], b - a
        w = size
        if kind == "poly" or flavour == "shrink":
            w = min(size, n)
            if kind != "mean":
                w -= 1 - w % 2
        else:
            w += 1 - w % 2
            if n < w:
                continue
        if w < (2 if kind == "mean" else 3) or (kind == "poly" and w <= order):
            continue
        for i in range(n):
            if kind == "poly":
                s = min(max(i - w // 2, 0), n - w)
                at = np.arange(w) - (i - s)
                out[a + i] = float(np.polyval(np.polyfit(at, part[s : s + w], order), 0))
            else:
                near = held(part, i, w // 2, w - 1 - w // 2)
                out[a + i] = float(np.median(near) if kind == "median" else np.mean(near))
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k, n in enumerate([0, 1, 2, 3, 4, 5, 9, 30, 30]):
        for i in range(n):
            gone = k == 8 and i in (3, 4, 9, 12, 20, 29) or k == 7 and i == 0
            rows.append((k, i * 2, None if gone else float(rng.normal()), None if i % 7 == 3 else float(i)))
    return spark.createDataFrame(rows, "k int, frame_index long, v double, w double")


@pytest.mark.parametrize("size", [1, 3, 4, 5, 15])
@pytest.mark.parametrize("kind,flavour", [("median", "shrink"), ("median", "skip"), ("mean", "shrink"), ("mean", "skip"), ("poly", "shrink")])
def test_filters(table, size, kind, flavour):
    if kind == "poly":
        out = kernels.savitzky_golay(table, K, ["v", "w"], size, 2)
    else:
        out = {"median": kernels.median_filter, "mean": kernels.mean_filter}[kind](table, K, ["v", "w"], size, flavour)
    assert out.columns == table.columns
    got, want = out.toPandas().sort_values(["k", "frame_index"]), table.toPandas().sort_values(["k", "frame_index"])
    for k in want["k"].unique():
        for c in ("v", "w"):
            values = [None if np.isnan(x) else x for x in want.loc[want["k"] == k, c]]
            wanted = values if size == 1 else brute(values, size, kind, flavour)
            found = [None if np.isnan(x) else x for x in got.loc[got["k"] == k, c]]
            assert found == [None if x is None else pytest.approx(x, abs=1e-9) for x in wanted], (k, c)
