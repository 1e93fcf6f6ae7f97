"""Reading tables."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal out the rows of a table that splits into fewer parts than cores.

    Tokenising, embedding and chunking cost CPU per row, so a file or two
    would leave most cores idle. A table of many files is left as it is. Dealt by
    a unique key, which spares the sort that dealing in turns needs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
