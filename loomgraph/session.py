"""Session plumbing."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers on this host find the package from where the driver has it.

    On a cluster the package is installed or shipped with ``--py-files``."""
    here, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH")) if x)
