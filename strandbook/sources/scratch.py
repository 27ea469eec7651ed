"""Where intermediate files go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table that has been counted is broadcast.
BROADCAST_ROWS = 1_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, the session's ``spark.checkpoint.dir``; who asks for it deletes it.

    Only a local session without one (tests) gets a temporary folder; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strandbook-scratch-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def counted_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked to be broadcast if it has been counted to have at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
