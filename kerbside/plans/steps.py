"""Steps between jobs: what is written once and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the folder that ``spark.checkpoint.dir`` names and cut its lineage. Only a
    session on one machine gets a temporary folder where that is unset: on a cluster it would
    split the rows over the machines, so it is an error there."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or f"{tempfile.gettempdir()}/kerbside-{uuid.uuid4().hex[:12]}")
    return df.checkpoint(eager=True)
