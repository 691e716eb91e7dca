"""Session settings that the plans of this package rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Set what is needed, and return the session.

    A union of equally partitioned inputs keeps their partitioning by default
    and then fails where adaptive execution has given the inputs different
    numbers of partitions; without it the union just concatenates them.

    Postings are scored in tasks that hold their documents whole, so a division
    must stay one partition, also where Spark sees no join or group that needs it.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    return spark
