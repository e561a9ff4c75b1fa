"""Sessions: a local one for the tests and the bench, and what any session needs."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local(cores: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A session on this machine; on a cluster make the session with the cluster's own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillgraph")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once a session; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_quillgraph_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quillgraph-")) / "quillgraph.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._quillgraph_shipped = True
