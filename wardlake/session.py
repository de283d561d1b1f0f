"""Session helpers: builder for local runs, checkpoint folder and size limits."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Rows that a lookup table may hold before it is no longer handed to every task.
MAX_DRIVER_ROWS = 10_000


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wardlake")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a session on one machine
    may leave it unset, as tests do; elsewhere that is an error, because executors would
    write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="wardlake-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, so Arrow functions can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_wardlake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="wardlake-pkg-")) / "wardlake.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    context._wardlake_shipped = True


def bounded_rows(df: DataFrame, limit: int = MAX_DRIVER_ROWS) -> list | None:
    """Rows of a lookup table, or None when it holds more than ``limit`` rows.

    At most ``limit + 1`` rows reach the driver, whatever the table's size.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None
