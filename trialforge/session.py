"""Spark session with the settings the engine relies on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "trialforge") -> SparkSession:
    """A local session for tests and benches; on a cluster pass the cluster's own session to the operators instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python can import it.

    Functions that run there are named by module; on a cluster, or where the driver was started elsewhere, nothing else
    brings the modules. Operators call this before they hand a function over.
    """
    sc, home = spark.sparkContext, Path(__file__).parent
    if getattr(sc, "_trialforge_shipped", False) or not home.is_dir():  # a package inside an archive was sent as one
        return
    out = Path(tempfile.mkdtemp(prefix="trialforge-")) / "trialforge.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, f"{home.name}/{p.relative_to(home)}")
    sc.addPyFile(str(out))
    sc._trialforge_shipped = True
