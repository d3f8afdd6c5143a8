"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import threading
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

Result = TypeVar("Result")
_inside = threading.local()


def partitions(df: DataFrame) -> int:
    """Number of shuffle partitions configured for the session of ``df``."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_folder(spark: SparkSession) -> str:
    """Reliable checkpoint folder: the one named by ``spark.checkpoint.dir``.

    Only a local session, whose tasks share the driver's disk, may do without the setting: it gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        local = sc.master == "local" or sc.master.startswith("local[")
        if named is None and not local:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and cut its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def single(df: DataFrame, message: str):
    """First row of an aggregate; a loud failure when it holds nothing."""
    row = df.first()
    if row is None or all(v is None for v in row):
        raise ValueError(message)
    return row


def together(spark: SparkSession, tasks: Sequence[Callable[[], Result]], at_most: int = 4) -> list[Result]:
    """Results of independent driver tasks in their order, ``at_most`` of them at the same time, each in a scheduler pool of
    its own. Tasks that start tasks themselves run those one after the other, so the bound holds."""
    if getattr(_inside, "busy", False) or len(tasks) < 2:
        return [t() for t in tasks]

    def run(numbered: tuple[int, Callable[[], Result]]) -> Result:
        _inside.busy = True
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"task-{numbered[0] % at_most}")
        try:
            return numbered[1]()
        finally:
            _inside.busy = False
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(at_most) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(run), t) for t in enumerate(tasks)]]
