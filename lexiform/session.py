"""Getting the package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of ``spark`` once, so that no install on them is needed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="lexiform-")) / "lexiform.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, str(f.relative_to(root.parent)))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Deal out rows of a table that lies in fewer files than there are cores: a file of one row group is one task,
    however many splits its scan shows. Larger tables stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > 4 * cores or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(2 * cores)


def bound_batches(spark: SparkSession, size: int) -> None:
    """Keep Arrow batches below ``size`` bytes, unless the session sets a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)).rstrip("b")) > 64 << 20:
        spark.conf.set(key, str(size))
