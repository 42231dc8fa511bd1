"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def folder(df: DataFrame) -> str:
    """The checkpoint folder, shared by all executors: that of ``spark.checkpoint.dir``.

    Where that is unset, as in tests, a temporary folder is set, on a local master only.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local($|\[)", context.master):
                raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on master {context.master}")
            base = "file://" + tempfile.mkdtemp(prefix="taproot-")
        context.setCheckpointDir(base)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, for plans of many rounds.

    A checkpoint keeps the estimated size of its plan, and joins multiply estimates, so that over many rounds
    their digits double; a table is as large as its files.
    """
    path = f"{folder(df)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
