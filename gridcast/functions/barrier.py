"""Training inside barrier stages: tasks that run side by side and exchange small arrays.

A stage holds one task per share of the data and takes many steps; at each step the tasks sum an
array of a size fixed by the model and the batch, never by the data. If a task or its executor
is lost, Spark runs the stage again from the weights it was given.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def slots(spark: SparkSession) -> int:
    """How many tasks surely run side by side."""
    return spark.sparkContext.defaultParallelism


def summed(context: BarrierTaskContext, part: np.ndarray | None, tasks: int) -> np.ndarray:
    """The sum of all tasks' arrays, in the order of the tasks; None adds nothing."""
    if tasks == 1:
        return part
    told = "" if part is None else base64.b64encode(part.tobytes()).decode()
    parts = [np.frombuffer(base64.b64decode(x)) for x in context.allGather(told) if x]
    total = parts[0].copy()
    for p in parts[1:]:
        total += p
    return total if part is None else total.reshape(part.shape)


def own_partitions(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers that a hash partitioning into ``n`` parts puts in parts 0 to n - 1."""
    part = F.pmod(F.hash("id"), F.lit(n))
    found = spark.range(max(64 * n, 64), numPartitions=1).groupBy(part.alias("part")).agg(F.min("id").alias("id")).collect()
    by_part = {r["part"]: r["id"] for r in found}
    return [by_part[i] for i in range(n)]


def dealt(df: DataFrame, share: Column, tasks: int) -> DataFrame:
    """``df`` with ``task``, one task for each value 0 to ``tasks - 1`` of ``share``."""
    labels = F.array(*[F.lit(x).cast("bigint") for x in own_partitions(df.sparkSession, tasks)])
    return df.withColumn("task", F.element_at(labels, share.cast("int") + 1)).repartition(tasks, "task")
