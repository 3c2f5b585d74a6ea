"""Views that recast the plain tables as trajectories, and the same views as SQL text for checks.

traj          events: a user is a clip, an event type a joint, its order in time a frame
traj_frame    the same by day: the last event of a user, day and joint, so that frames hold several joints
markers       embeddings: a label is a trial, three components a marker
entity_metrics  customers' mean order price by priority: a long metric table
scalars       line items of a part in order of shipping: a scalar series
skeleton      markers as the joints of a body: a struct for each joint, one row a frame
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Which joint stands for which event type.
JOINTS = {"error": "right_shoulder", "click": "right_elbow", "purchase": "right_wrist", "signup": "left_hip", "view": "right_hip"}
KEYS = ["clip_id", "condition_id"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    joint = F.create_map(*[F.lit(x) for kv in JOINTS.items() for x in kv])
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01', ts)") / F.lit(1e6)
    return e.select(
        F.col("user_id").cast("string").alias("clip_id"), F.lit("raw").alias("condition_id"), "ts", "event_id", seconds.alias("timestamp_sec"), F.element_at(joint, F.col("event_type")).alias("joint_name"),
        (F.col("value") / 500).alias("x"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("y"),
        ((F.col("event_id") * 37 % 100) / 100).alias("visibility"), ((F.col("event_id") * 53 % 100) / 100).alias("confidence"),
    )


def traj(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = F.row_number().over(Window.partitionBy("clip_id").orderBy("ts", "event_id")) - 1
    return _points(spark, sf_dir).withColumn("frame_index", frame.cast("long")).drop("ts", "event_id")


def traj_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).withColumn("frame_index", F.floor(F.col("timestamp_sec") / 86400))
    last = F.max_by(F.struct("x", "y", "visibility", "confidence"), F.struct("ts", "event_id")).alias("p")
    p = p.groupBy("clip_id", "condition_id", "frame_index", "joint_name").agg(last)
    return p.select("clip_id", "condition_id", "frame_index", (F.col("frame_index") / 30).alias("timestamp_sec"), "joint_name", "p.*", F.lit("adapter").alias("backend"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").withColumn("frame_index", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long"))
    e = e.select(F.col("label").alias("trial_id"), "frame_index", (F.col("frame_index") / 100).alias("timestamp_sec"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("marker"))
    at = lambda k: (F.get("embedding", F.col("marker") * 3 + k).cast("double") * 1000)
    return e.select("trial_id", "frame_index", "timestamp_sec", "marker", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def marker_frames(spark: SparkSession, sf_dir: str, names: list[int]) -> DataFrame:
    """One row a frame with a struct m0, m1, ... for each wanted marker."""
    m = markers(spark, sf_dir).filter(F.col("marker").isin(*names))
    return m.groupBy("trial_id", "frame_index", "timestamp_sec").agg(*[F.max(F.when(F.col("marker") == k, F.struct("x", "y", "z"))).alias(f"m{k}") for k in names])


#: The joint that each marker stands for.
SKELETON = [
    "head", "neck", "hip", *[f"{s}_{j}" for j in ("shoulder", "elbow", "wrist", "hand", "hip", "knee", "ankle", "foot") for s in ("left", "right")], "bat1", "bat5",
]


def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = markers(spark, sf_dir)
    pick = [F.max(F.when(F.col("marker") == k, F.struct("x", "y", "z"))).alias(joint) for k, joint in enumerate(SKELETON)]
    return m.groupBy("trial_id", "frame_index", "timestamp_sec").agg(*pick)


def entity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    value = F.round(F.avg("o_totalprice"), 4).alias("value")
    return o.groupBy(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("metric")).agg(value).join(c.select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment")), "entity")


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_suppkey", "l_discount", "l_tax")
    return li.select(F.col("l_partkey").alias("series"), (F.row_number().over(order) - 1).cast("long").alias("frame_index"), F.col("l_extendedprice").alias("value"))


_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in JOINTS.items())
_POINTS = f"""points AS (
  SELECT CAST(user_id AS VARCHAR) AS clip_id, 'raw' AS condition_id, ts, event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS timestamp_sec,
    CASE event_type {_CASE} END AS joint_name, value / 500 AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS y,
    (event_id * 37 % 100) / 100 AS visibility, (event_id * 53 % 100) / 100 AS confidence
  FROM events)"""
TRAJ = f"""{_POINTS}, traj AS (
  SELECT * EXCLUDE (ts, event_id), row_number() OVER (PARTITION BY clip_id ORDER BY ts, event_id) - 1 AS frame_index FROM points)"""
TRAJ_FRAME = f"""{_POINTS}, traj_frame AS (
  SELECT clip_id, condition_id, frame_index, frame_index / 30 AS timestamp_sec, joint_name, x, y, visibility, confidence, 'adapter' AS backend FROM (
    SELECT *, CAST(floor(timestamp_sec / 86400) AS BIGINT) AS frame_index,
      row_number() OVER (PARTITION BY clip_id, floor(timestamp_sec / 86400), joint_name ORDER BY ts DESC, event_id DESC) AS rn FROM points) WHERE rn = 1)"""
MARKERS = """markers AS (
  SELECT trial_id, frame_index, frame_index / 100 AS timestamp_sec, marker, CAST(embedding[3 * marker + 1] AS DOUBLE) * 1000 AS x,
    CAST(embedding[3 * marker + 2] AS DOUBLE) * 1000 AS y, CAST(embedding[3 * marker + 3] AS DOUBLE) * 1000 AS z
  FROM (SELECT label AS trial_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index, embedding FROM embeddings), (SELECT CAST(range AS INTEGER) AS marker FROM range(21)))"""
ENTITY_METRICS = """entity_metrics AS (
  SELECT o_custkey AS entity, o_orderpriority AS metric, round(avg(o_totalprice), 4) AS value, any_value(c_mktsegment) AS segment
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""
SCALARS = """scalars AS (
  SELECT l_partkey AS series, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_suppkey, l_discount, l_tax) - 1 AS frame_index, l_extendedprice AS value FROM lineitem)"""


def marker_frames_sql(names: list[int]) -> str:
    cols = ", ".join(f"max(CASE WHEN marker = {k} THEN {a} END) AS m{k}{a}" for k in names for a in "xyz")
    return f"{MARKERS}, frames AS (SELECT trial_id, frame_index, timestamp_sec, {cols} FROM markers GROUP BY ALL)"


def skeleton_sql() -> str:
    """A view frames with columns <joint>_x, <joint>_y, <joint>_z."""
    cols = ", ".join(f"max(CASE WHEN marker = {k} THEN {a} END) AS {joint}_{a}" for k, joint in enumerate(SKELETON) for a in "xyz")
    return f"{MARKERS}, frames AS (SELECT trial_id, frame_index, timestamp_sec, {cols} FROM markers GROUP BY ALL)"
