"""Sends the package to Python workers that cannot import it otherwise."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file once per context, unless workers find it by PYTHONPATH or in their working directory."""
    context = spark.sparkContext
    paths = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT) in paths or Path.cwd() == ROOT or getattr(context, "_chromaloom_shipped", False):
        return
    made = shutil.make_archive(f"{tempfile.mkdtemp()}/chromaloom", "zip", ROOT, "chromaloom")
    context.addPyFile(made)
    context._chromaloom_shipped = True
