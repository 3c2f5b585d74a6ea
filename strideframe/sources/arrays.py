"""Array archives and spreadsheets: one file a row through binaryFile, decoded in tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

NPZ_SCHEMA = "path string, frame_index long, joint_name string, x_3d double, y_3d double, z_3d double, input_quality_score double"
CELL_SCHEMA = "path string, sheet string, sheet_index long, row long, column long, value string"
KEYS = ("joints", "joints_3d", "keypoints_3d", "positions")


def decode_npz(data: bytes, names: list[str] | None = None) -> pd.DataFrame:
    """A (frames, joints, 3) array as long rows; joint names from the file or given, scores by frame or by frame and joint if there are any."""
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        points = np.asarray(next(z[k] for k in KEYS if k in z.files), dtype=float)
        if points.ndim != 3 or points.shape[2] != 3:
            raise ValueError(f"expected (frames, joints, 3), not {points.shape}")
        labels = names or [str(x) for x in z["joint_names"]]
        scores = np.asarray(z["scores"], dtype=float) if "scores" in z.files else np.full(points.shape[:2], np.nan)
    if len(labels) != points.shape[1]:
        raise ValueError("joint names do not match the array")
    scores = np.broadcast_to(scores[:, None] if scores.ndim == 1 else scores, points.shape[:2])
    frames, joints = points.shape[:2]
    out = pd.DataFrame(points.reshape(-1, 3), columns=["x_3d", "y_3d", "z_3d"])
    out.insert(0, "frame_index", np.repeat(np.arange(frames), joints))
    out.insert(1, "joint_name", labels * frames)
    out["input_quality_score"] = scores.ravel()
    return out.replace({np.nan: None})


def decode_xlsx(data: bytes) -> list[tuple[str, int, int, int, str]]:
    """(sheet, its number, row, column, text) of all filled cells, numbers, rows and columns from 0."""
    local = lambda e: e.tag.rpartition("}")[2]
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if local(si) == "si"]
        titles = [e.get("name", "") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"]
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        for number, (title, name) in enumerate(zip(titles, sheets, strict=False)):
            for cell in (e for e in ElementTree.fromstring(z.read(name)).iter() if local(e) == "c"):
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
                column = 0
                for c in letters:
                    column = column * 26 + ord(c) - 64
                text = "".join(e.text or "" for e in cell.iter() if local(e) in ("v", "t"))
                if text:
                    out.append((title, number, int(row) - 1, column - 1, shared[int(text)] if cell.get("t") == "s" else text))
    return out


def _files(spark: SparkSession, path: str, ending: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").option("recursiveFileLookup", True).load(path).select("path", "content")


def read_npz(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                t = decode_npz(bytes(content), names)
                t.insert(0, "path", name)
                yield t

    return _files(spark, path, "npz").mapInPandas(run, NPZ_SCHEMA)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all sheets of all workbooks; further shaping is a matter of joins and pivots."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame([(name, *c) for c in decode_xlsx(bytes(content))], columns=[c.split()[0] for c in CELL_SCHEMA.split(", ")])

    return _files(spark, path, "xlsx").mapInPandas(run, CELL_SCHEMA)
