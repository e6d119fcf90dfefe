"""Small tables that are used several times, computed once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


class NoSharedFolder(ValueError):
    """A cluster without a folder that the driver and all executors share."""


def kept(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a checkpoint in the folder that the cluster shares (``spark.checkpoint.dir``)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.partition("[")[0] == "local":
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint()
