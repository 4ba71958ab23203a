"""Parents and children kept together: tables bucketed and sorted by one key, so that joins and groups on it need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from paperlens.sources.scratch import folder

#: Buckets of a small table. All tables of one key need the same number.
BUCKETS = 8


def bucketed(rows: DataFrame, key: str, order: list[str], name: str, buckets: int = BUCKETS) -> DataFrame:
    """rows as a table of one file a bucket, in the shared folder. The number of buckets is fixed when the table is made: choose it for the
    table's size (some hundred MB a bucket), alike for all tables that meet on the key."""
    spark = rows.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    writer = rows.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key, *order)
    writer.option("path", folder(spark, name)).saveAsTable(table)
    return spark.table(table)
