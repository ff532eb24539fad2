"""Written steps of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from treeline.session import scratch_path

#: Lets Spark remove the shuffle files of a statement when it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    That cuts lineage, survives lost executors, and frees the disk of the shuffles that led to it.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Removes the folders of tables made by ``stage``, once all that read them has been written."""
    for table in tables:
        session = table.sparkSession
        path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(table.staged_path)
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
