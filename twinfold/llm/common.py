"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import pickle
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
WORD = re.compile(r"\w+")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path may be in any store Spark can read."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Let local workers import this package, and set the checkpoint folder that the cluster names in spark.checkpoint.dir.

    A folder of this machine stands in for it only where all of Spark runs on this machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="twinfold-"))
    known = sc.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, ROOT) if x)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder; survives lost executors."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


#: Keys with more than this share of the rows are joined by broadcast.
SHARE = 1000


def join_by_size(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join with a table that has each key once and in ``size`` how many rows have it, total in all.

    Keys of more than a thousandth of the total, fewer than a thousand if each row has one key,
    meet their rows by broadcast, all others by shuffle: no task gets a hot key, and what
    is broadcast has a bound. Both inputs are read twice and should be cheap or durable.
    """
    often = F.broadcast(table.where(F.col(size) * SHARE > total))
    rare = table.where(F.col(size) * SHARE <= total)
    rest = rows.join(often.select(key), key, "left_anti").join(rare, key)
    return rows.join(often, key).unionByName(rest)


def fit_in_one_task(sample: DataFrame, fit: Callable[[Iterable[pa.RecordBatch]], Any]) -> Any:
    """The model that fit makes of all batches of a bounded sample; only the model reaches the driver.

    Adaptive execution drops a plan over no rows whole, so the model of an empty sample is made here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(batches))], pa.binary())], names=["model"])

    row = sample.mapInArrow(run, "model binary").first()
    return pickle.loads(row["model"]) if row else fit([])


def folded_crc(column: str) -> Column:
    """The fold of a row: crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def words(text: str | None) -> list[str]:
    """Lower-cased runs of word characters."""
    return WORD.findall(text.lower()) if text else []
