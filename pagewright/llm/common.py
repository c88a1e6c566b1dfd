"""What the operators of this subpackage share: reading tables, cutting lineage, streaming sorted groups."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to a Python worker, of whatever the operator: a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
#: Keys that spread_join() sends to all tasks, at most.
HOT_KEYS = 1000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="pagewright-")) / "pagewright_src.zip"  # the driver's file server hands it out
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, to the same figure for all operators; a lower bound of the user's own stays.

    The bound is read when a plan is run, so it can't be set for one plan alone. Numbers of rows are left as they are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in local mode, where none is named."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "pagewright-checkpoints"))
    return sc.getCheckpointDir().rstrip("/")


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ours, wherever its file system is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(rows: DataFrame, per_key: DataFrame, on: list[str], how: str = "inner", most: int = HOT_KEYS) -> DataFrame:
    """rows joined (inner or left) with a table of one row per key, whichever keys are hot.

    Fewer than `most` keys can have more than one in `most` of all rows: their side of the join is broadcast and their rows
    stay where they are; the others are shuffled. Counts are combined before their shuffle. rows is read several times,
    so it should be a checkpoint or cheap to compute."""
    n = rows.count()
    held = rows.groupBy(*on).agg(F.count("*").alias("_held")).where(F.col("_held") > max(n // most, 200))
    hot = cut(held.select(*on))
    if hot.isEmpty():
        return rows.join(per_key, on, how)
    hot = F.broadcast(hot)
    near = rows.join(hot, on, "left_semi").join(F.broadcast(cut(per_key.join(hot, on, "left_semi"))), on, how)
    return near.unionByName(rows.join(hot, on, "left_anti").join(per_key, on, how))


def grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups out of batches that are sorted by the keys. A group may span batches; what is held is one group and one batch."""
    held: list[pd.DataFrame] = []
    last: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        values = [batch[k].to_numpy() for k in keys]
        change = np.zeros(len(batch), dtype=bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        first = tuple(v[0] for v in values)
        if last is not None and first != last:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        bounds = [0, *starts.tolist(), len(batch)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            part = batch.iloc[a:b]
            if b < len(batch):
                yield pd.concat([*held, part], ignore_index=True) if held else part
                held = []
            else:
                held.append(part)
        last = tuple(v[-1] for v in values)
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def nonempty_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit("")))


def buffered(batches: Iterator[pd.DataFrame], column: str = "text", chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Join small batches until they hold about so many characters: vectorised steps then have enough rows to work on."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += int(b[column].str.len().sum())
        if size >= chars:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)
