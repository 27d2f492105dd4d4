"""What all operators share: intermediate tables, batches of bounded size, the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.sources.tables import BLOCK_BYTES, new_path, spent, written

__all__ = ["BATCH_ROWS", "BLOCK_BYTES", "new_path", "small_batches", "spent", "table", "written"]

#: Rows and bytes of an Arrow batch. Rows with texts are wide, and a batch exists several times: in the JVM, on the way, in the worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The same table; from here on its session hands at most BATCH_ROWS rows, or about BATCH_BYTES, at a time to Python workers (or
    less, where set so).
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    most = conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")
    if not most.isdigit() or int(most) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
