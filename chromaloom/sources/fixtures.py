"""A sample catalog made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .catalog import TrackCatalog
from .views import contacts


def sample_catalog(spark: SparkSession, sf_dir: str, root: str) -> TrackCatalog:
    """A catalog at ``root`` with the tracks hic.obs and hic.obs_shuffle; built once."""
    catalog = TrackCatalog(spark, root)
    for name, src in (("hic.obs", "obs"), ("hic.obs_shuffle", "exp")):
        if not catalog.exists(name):
            catalog.write(name, contacts(spark, sf_dir, src))
    return catalog
