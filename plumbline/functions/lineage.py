"""Reliable checkpoints of results that a query reads more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """`df` written once to the folder that the session names in spark.checkpoint.dir, its plan cut there.

    Where that is unset, a session on one machine gets a temporary folder; on a cluster it is an error, since
    executors could not write a driver's folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()
