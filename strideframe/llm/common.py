"""Small helpers that the operators of this package share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset (tests), a temporary one on a local master; a cluster without one is an error."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="strideframe-")
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strideframe-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the frame as Parquet into the shared folder and read it back: lineage ends there and later readers prune columns."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored frame that nothing reads any more, through the file systems that Spark itself knows."""
    sc = df.sparkSession.sparkContext
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Schemes of Spark's connectors, and what the file systems that tasks open call them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI as Spark spells it, for tasks that read or write single files, and the path in it."""
    scheme, sep, rest = uri.partition("://")
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + sep + rest)


#: Texts are long: a batch of rows on its way to Python ends at so many bytes.
BATCH_BYTES = "4m"
#: The bound's name, and what Spark takes for it where nobody has set it.
BATCH_KEY, UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def numbered(df: DataFrame, *order: Column | str, row: str = "row", name: str = "numbered") -> DataFrame:
    """The frame, stored, with consecutive numbers from 0 in the given order: a range sort and each part's offset, no task sees all rows.

    The offsets are a row for each part of the sort, whatever the number of rows; rows that are equal in the order come in any.
    """
    sorted_parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(sorted_parts.withColumn(row, F.monotonically_increasing_id()), name)
    part = F.shiftright(row, 33)
    counts = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for k, n in counts:
        starts.append((k, total - (k << 33)))
        total += n
    offset = free_name(df, "_offset")
    offsets = df.sparkSession.createDataFrame(starts, f"_part long, {offset} long")
    return placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn(row, F.col(row) + F.col(offset)).select(*df.columns, row)


def ordered_digests(pieces: DataFrame, key: str, order: str, piece: str, sep: str) -> DataFrame:
    """key, sha256: of each key's pieces in order, joined by sep. The pieces of a key pass a task as a stream, never as one text."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for pdf in batches:
            done: list[tuple[str, str]] = []
            for k, text in zip(pdf[key], pdf[piece], strict=True):
                if digest is None or k != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = k, hashlib.sha256(text.encode())
                else:
                    digest.update(sep.encode())
                    digest.update(text.encode())
            yield pd.DataFrame(done, columns=[key, "sha256"])
        if digest is not None:
            yield pd.DataFrame([(now, digest.hexdigest())], columns=[key, "sha256"])

    parts = pieces.select(key, order, piece).repartition(key).sortWithinPartitions(key, order)
    return in_short_batches(parts).select(key, piece).mapInPandas(hashed, f"{key} string, sha256 string")


def in_short_batches(df: DataFrame) -> DataFrame:
    """The frame itself, once its session bounds Arrow batches by bytes.

    Spark reads that bound from the session when a plan runs, so it can't go with one frame: it stays for the session, and one
    that the application has set, by whichever way, is left alone.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY) == UNSET:
        conf.set(BATCH_KEY, BATCH_BYTES)
    return df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_type(df: DataFrame, name: str = "doc_id") -> str:
    return df.schema[name].dataType.simpleString()


def as_text(name: str = "doc_id") -> Column:
    """An id on its way through pandas, where a long beside a null would become a float; cast it back behind."""
    return F.col(name).cast("string").alias(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def hash_below(col: Column, fraction: float, salt: int) -> Column:
    """True for about the given fraction of the values, the same ones on every run."""
    return F.pmod(F.xxhash64(col, F.lit(salt)), F.lit(1_000_000)) < F.lit(round(min(1.0, fraction) * 1_000_000))


def slices(texts, chars: int = 1_000_000) -> Iterator[list[str | None]]:
    """Lists of about so many characters each, so that a batch of long texts needs little memory at a time."""
    part, size = [], 0
    for t in texts:
        part.append(t if isinstance(t, str) else None)
        size += len(t) if isinstance(t, str) else 1
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part
