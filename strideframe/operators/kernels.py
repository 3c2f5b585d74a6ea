"""Filters over stretches without a gap, as window expressions: medians, Savitzky-Golay fits and means.

Two flavours differ at short stretches and even windows. "shrink" fits the window to the stretch; "skip" makes even windows one
longer and leaves stretches shorter than the window alone. A row's window is an array of its neighbours, at most twice the
filter's size, so a series of any length is sorted once and never held as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import Keys, along


def _filtered(df: DataFrame, keys: Keys, columns: list[str], size: int, of: Callable[[Column, Column, Column, Column], Column], order: str) -> DataFrame:
    """Replace columns by of(neighbours, place of the row among them, position in the stretch, length of the stretch); null keeps the value.

    The neighbours reach size - 1 rows to either side, as far as the stretch goes; position and length count no further than that, which
    is as far as any window looks. All columns share one order of the series: a stretch is cut out of the values around the row.
    """
    w = along(keys, order)
    upto, near, back, ahead = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(1 - size, size - 1), w.rowsBetween(1 - size, -1), w.rowsBetween(1, size - 1)
    df = df.withColumn("_pos", F.row_number().over(w))
    df = df.withColumns({f"_gap_{c}": F.when(F.col(c).isNull(), F.col("_pos")) for c in columns})
    seen = {"_rows": F.count(F.lit(1)).over(ahead)}
    for c in columns:
        # The last gap up to the row, the next gap ahead, the values around the row and how many of them lie before it.
        seen |= {f"_last_{c}": F.max(f"_gap_{c}").over(upto), f"_next_{c}": F.min(f"_gap_{c}").over(ahead), f"_near_{c}": F.collect_list(c).over(near), f"_before_{c}": F.count(c).over(back)}
    df = df.withColumns(seen)
    reach, cut = {}, {}
    for c in columns:
        own = F.least(F.col("_pos") - F.coalesce(f"_last_{c}", F.lit(0)) - 1, F.lit(size - 1))
        behind = F.coalesce(F.col(f"_next_{c}") - F.col("_pos") - 1, F.col("_rows"))
        reach |= {f"_own_{c}": F.when(F.col(c).isNotNull(), own).cast("int"), f"_n_{c}": F.when(F.col(c).isNotNull(), own + 1 + behind).cast("int")}
        cut[f"_near_{c}"] = F.slice(f"_near_{c}", (F.col(f"_before_{c}") - F.col(f"_own_{c}") + 1).cast("int"), F.col(f"_n_{c}"))
    df = df.withColumns(reach).withColumns(cut)
    value = {c: F.coalesce(of(F.col(f"_near_{c}"), F.col(f"_own_{c}"), F.col(f"_own_{c}"), F.col(f"_n_{c}")), F.col(c)) for c in columns}
    df = df.withColumns({c: F.when(F.col(c).isNotNull(), v) for c, v in value.items()})
    return df.drop("_pos", "_rows", *[f"_{k}_{c}" for k in ("gap", "last", "next", "near", "before", "own", "n") for c in columns])


def _window(size: int, length: Column, flavour: str, odd: bool) -> Column:
    """The window for a stretch; null leaves it alone."""
    if flavour == "skip":
        size += 1 - size % 2
        return F.when(length >= size, F.lit(size))
    fitted = F.least(F.lit(size), length)
    return (fitted - (1 - fitted % 2) if odd else fitted).cast("int")


def _reach(size: int, flavour: str) -> int:
    return size + 1 - size % 2 if flavour == "skip" else size


def _held(near: Column, own: Column, width: Column) -> Column:
    """The values of a window around the row; beyond the stretch its end values go on."""
    last = F.size(near)
    return F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.element_at(near, F.greatest(F.lit(1), F.least(last, own + j - F.floor(width / 2).cast("int") + 1)).cast("int")))


def median_filter(df: DataFrame, keys: Keys, columns: list[str], size: int, flavour: str = "shrink", *, order: str = "frame_index") -> DataFrame:
    if size <= 1:
        return df

    def of(near: Column, own: Column, i: Column, n: Column) -> Column:
        width = _window(size, n, flavour, odd=True)
        return F.when(width >= 3, F.element_at(F.array_sort(_held(near, own, width)), (F.floor(width / 2) + 1).cast("int")))

    return _filtered(df, keys, columns, _reach(size, flavour), of, order)


def mean_filter(df: DataFrame, keys: Keys, columns: list[str], size: int, flavour: str = "shrink", *, order: str = "frame_index") -> DataFrame:
    if size <= 1:
        return df

    def of(near: Column, own: Column, i: Column, n: Column) -> Column:
        width = _window(size, n, flavour, odd=False)
        return F.when(width >= 2, F.aggregate(_held(near, own, width), F.lit(0.0), lambda a, v: a + v) / width)

    return _filtered(df, keys, columns, _reach(size, flavour), of, order)


def _weights(size: int, order: int) -> dict[tuple[int, int], list[float]]:
    """For each odd window up to size and each place in it: weights of the values for the polynomial's value at that place."""
    out = {}
    for width in range(3, size + 1, 2):
        if width > order:
            basis = np.vander(np.arange(width) - width // 2.0, order + 1, increasing=True)
            fit = basis @ np.linalg.pinv(basis)
            out |= {(width, p): fit[p].tolist() for p in range(width)}
    return out


def savitzky_golay(df: DataFrame, keys: Keys, columns: list[str], size: int, order: int, *, by: str = "frame_index") -> DataFrame:
    """Least-squares polynomial at each window's middle; at the ends the first and last window's polynomial. Stretches too short for one stay."""
    weights = _weights(size, order)
    if not weights:
        return df
    table = F.create_map(*[x for (width, p), row in weights.items() for x in (F.lit(width * size + p), F.array(*[F.lit(v) for v in row]))])

    def of(near: Column, own: Column, i: Column, n: Column) -> Column:
        fitted = F.least(F.lit(size), n)
        width = (fitted - (1 - fitted % 2)).cast("int")
        half = F.floor(width / 2)
        place = i - F.greatest(F.lit(0), F.least(i - half, n - width))
        row = F.try_element_at(table, (width * size + place).cast("int"))
        products = F.zip_with(F.slice(near, (own - place + 1).cast("int"), width), row, lambda v, w: v * w)
        return F.when(row.isNotNull(), F.aggregate(products, F.lit(0.0), lambda a, v: a + v))

    return _filtered(df, keys, columns, size, of, by)
