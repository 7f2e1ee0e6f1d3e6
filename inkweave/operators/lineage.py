"""Cutting lineage where several steps read a result."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the folder that the session names in ``spark.checkpoint.dir``, which executors share and a lost one doesn't take
    along. A local session without one gets a temporary folder; a cluster has to name its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        place = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not place and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(place or "file://" + tempfile.mkdtemp(prefix="inkweave-"))
    return df.checkpoint()
