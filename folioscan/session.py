"""Sessions and code distribution."""

from __future__ import annotations

import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_shipped: weakref.WeakSet[SparkContext] = weakref.WeakSet()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once a context, so their Python workers can import it."""
    context = spark.sparkContext
    if context in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="folioscan-code-")) / "folioscan_code.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context)


#: Bytes (as stored) below which a table may be a few splits, or one row group, whatever the number of cores.
SMALL_BYTES = 64 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A small table dealt over all cores, so that heavy work on its rows isn't one task's; a larger one is left where it lies."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size < SMALL_BYTES and cores > 1 else df


def local_session(name: str = "folioscan", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine for tests, benchmarks and exploration."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
