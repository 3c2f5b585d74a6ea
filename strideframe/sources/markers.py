"""Marker files: binary C3D trials and wide marker CSVs, one file a row through Spark's binaryFile reader, decoded in tasks."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MARKERS

BLOCK = 512


def _parameters(data: bytes, block: int) -> dict[tuple[str, str], list]:
    """Values of (group, name) from a C3D parameter section. Groups have negative numbers; a parameter names its group by the positive one."""
    at, groups, found = (block - 1) * BLOCK + 4, {}, {}
    while at + 2 <= len(data):
        length, group = struct.unpack_from("<bb", data, at)
        if length == 0:
            break
        name = data[at + 2 : at + 2 + abs(length)].decode("latin-1").strip().upper()
        step_at = at + 2 + abs(length)
        (step,) = struct.unpack_from("<H", data, step_at)
        if group < 0:
            groups[-group] = name
        else:
            kind, rank = struct.unpack_from("<bB", data, step_at + 2)
            dims = list(data[step_at + 4 : step_at + 4 + rank])
            found[group, name] = _values(data, step_at + 4 + rank, kind, dims)
        if step == 0:
            break
        at = step_at + step
    return {(groups.get(g, ""), name): v for (g, name), v in found.items()}


def _values(data: bytes, at: int, kind: int, dims: list[int]) -> list:
    count = int(np.prod(dims)) if dims else 1
    if kind == -1:
        width = dims[0] if dims else 1
        return [data[at + k * width : at + (k + 1) * width].decode("latin-1").strip() for k in range(count // max(width, 1))]
    form = {1: "b", 2: "<h", 4: "<f"}.get(kind)
    return np.frombuffer(data, form, count, at).tolist() if form else []


def clean_label(label: str) -> str:
    """A label without its subject: what stands behind the first colon."""
    subject, colon, name = label.partition(":")
    return (name if colon else subject).strip()


def decode_c3d(data: bytes, trial_id: str) -> pd.DataFrame:
    """Rows of MARKERS. A point is missing where its residual is negative or all its coordinates are 0."""
    if data[1] != 0x50:
        raise ValueError("not a C3D file")
    points, _, first, last = struct.unpack_from("<HHHH", data, 2)
    scale, start, per_frame, rate = struct.unpack_from("<fHHf", data, 12)
    found = _parameters(data, data[0])
    labels = [str(x) for x in found.get(("POINT", "LABELS"), [])]
    labels += [f"point_{k}" for k in range(len(labels), points)]
    units = (found.get(("POINT", "UNITS")) or ["mm"])[0]
    frames = last - first + 1
    analog = struct.unpack_from("<H", data, 4)[0]
    kind, width = ("<f4", 4) if scale < 0 else ("<i2", 2)
    per = 4 * points + analog
    values = np.frombuffer(data, kind, frames * per, (start - 1) * BLOCK).reshape(frames, per)[:, : 4 * points].reshape(frames, points, 4).astype(float)
    xyz, residual = values[..., :3] * (1 if scale < 0 else scale), values[..., 3]
    xyz = xyz * {"m": 1000.0, "cm": 10.0}.get(units.lower(), 1.0)
    lost = (residual < 0) | np.isclose(xyz, 0).all(axis=2)
    xyz[lost] = np.nan
    frame = np.repeat(np.arange(frames), points)
    return _rows(trial_id, frame, frame / (rate or 1.0), [clean_label(x) for x in labels[:points]] * frames, xyz.reshape(-1, 3), residual.ravel(), ~lost.ravel())


def decode_marker_csv(data: bytes, trial_id: str) -> pd.DataFrame:
    """Rows of MARKERS from a wide export: rate in line 2, a label over each coordinate triple in line 3, data from line 6 on, frame numbers from 1.

    A marker with a blank coordinate is missing in that frame.
    """
    lines = [x.split(",") for x in data.decode("utf-8-sig", "replace").splitlines()]
    rate = float(lines[1][0])
    labels = [(k, clean_label(x.strip())) for k, x in enumerate(lines[2]) if x.strip()]
    out = []
    for line in lines[5:]:
        if not line or not line[0].strip():
            continue
        frame = int(float(line[0])) - 1
        for k, label in labels:
            cell = [x.strip() for x in line[k : k + 3]]
            there = len(cell) == 3 and all(cell)
            out.append((frame, label, *(map(float, cell) if there else (np.nan,) * 3), there))
    t = pd.DataFrame(out, columns=["frame", "label", "x", "y", "z", "there"])
    return _rows(trial_id, t["frame"].to_numpy(), t["frame"].to_numpy() / rate, list(t["label"]), t[["x", "y", "z"]].to_numpy(float), np.full(len(t), np.nan), t["there"].to_numpy(bool))


def _rows(trial_id, frame, time, label, xyz, residual, valid) -> pd.DataFrame:
    return pd.DataFrame({
        "trial_id": trial_id, "frame_index": np.asarray(frame, dtype=np.int64), "timestamp_sec": np.asarray(time, dtype=float), "point": label,
        **{f"{a}_mm": pd.array(np.where(valid, xyz[:, i], np.nan), dtype="Float64") for i, a in enumerate("xyz")}, "residual": residual, "valid": np.asarray(valid, dtype=np.int32),
    }).replace({np.nan: None})


def trial_id(path: str) -> str:
    """Folder and file name in lower case, blanks as underscores."""
    p = PurePosixPath(path)
    return f"{p.parent.name}_{p.stem}".replace("%20", " ").replace(" ", "_").lower()


def read_markers(spark: SparkSession, path: str, kind: str = "c3d") -> DataFrame:
    """All points of all trials below a path; kind: c3d or csv."""
    decode = {"c3d": decode_c3d, "csv": decode_marker_csv}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                yield decode(bytes(content), trial_id(name))

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, MARKERS)


def named_joints(markers: DataFrame, names: dict[str, str], *, condition_id: str = "markers") -> DataFrame:
    """Marker rows as POSE3D rows of the joints that a table of marker names knows; lost points have a quality of 0."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    df = markers.withColumn("joint_name", F.try_element_at(table, F.col("point"))).filter("joint_name is not null")
    return df.select(
        F.col("trial_id").alias("clip_id"), F.lit(condition_id).alias("condition_id"), "frame_index", "timestamp_sec", "joint_name", *[F.col(f"{a}_mm").alias(f"{a}_3d") for a in "xyz"],
        F.lit("millimetres").alias("scale_mode"), F.lit("markers").alias("lift_backend"), F.col("valid").cast("double").alias("input_quality_score"),
    )
