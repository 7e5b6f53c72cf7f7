"""Reliable checkpoints in the folder that the session names."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def keep(frame: DataFrame) -> DataFrame:
    """Write a frame to spark.checkpoint.dir (a folder of our own in a local session that names none) and read it back."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "leafmill-checkpoints"))
    return frame.checkpoint()
