"""Cutting the lineage of iterative operators with tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read back; a temporary folder is set only where a local session leaves that unset."""
    spark = df.sparkSession
    if not (shared := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='quarryloom-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
