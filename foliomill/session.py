"""Session helpers: shipping this package to the Python workers, and cutting lineage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the workers this package, once an application; a cluster that has it installed loses nothing by it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        handle, at = tempfile.mkstemp(prefix="foliomill-", suffix=".zip")
        os.close(handle)
        atexit.register(Path(at).unlink, missing_ok=True)
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(at)
        _shipped.add(app)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write the frame to the folder of spark.checkpoint.dir and read it from there: plans stay small, and lost executors cost no recomputation.

    Only a local session without that setting, as in tests, gets a folder of its own; on a cluster without it this is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if at is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        context.setCheckpointDir(at or os.path.join(tempfile.gettempdir(), "foliomill-checkpoints"))
    return df.checkpoint()
