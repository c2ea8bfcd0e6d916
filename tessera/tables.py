"""Intermediate tables in the folder that driver and executors share, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, as a whole URI: a path without a scheme is one of the default file system.

    Without that setting a local session, as in tests, takes a temporary folder; any other is refused, since its executors would share nothing.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    if whole.startswith("file:/") and not whole.startswith("file://"):
        whole = "file://" + whole[len("file:") :]
    return f"{whole.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Remove all that this application has written to the shared folder. Results that read from there are to be written elsewhere before."""
    at = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    The rows are then safe from lost executors and are computed once. A written table, unlike checkpoint(),
    also forgets how it was partitioned, so that joins on it deal both sides out anew and AQE can split hot keys.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def appended(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """The rows of all parts, each run and added to one table before the next one is made; what is read back is one scan, however many there were."""
    path, schema, spark = "", None, None
    for df in parts:
        spark = df.sparkSession
        path, schema = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", df.schema
        df.write.mode("append").parquet(path)
    if spark is None:
        raise ValueError("there are no parts")
    return spark.read.schema(schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like written(), as a table bucketed by key in the shared folder: groups and joins on the key (and more) then need no exchange. df is dealt by key first, so that each bucket is one file."""
    spark = df.sparkSession
    n = n_partitions(spark)
    table = f"tessera_{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).format("parquet").option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b), long ids: a row (node, label) per node with an edge; label is the least node reachable.

    Each round takes the least label among the neighbours and then the label of that label, so that long
    chains shrink by doubling. Rounds end when no label has changed. Hubs are ordinary: minima are taken in two steps,
    and every join is between freshly dealt tables, which AQE splits where a key is hot.
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges"
    )
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        met = written(
            labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "met"
        )
        up = met.select(F.col("node").alias("label"), F.col("label").alias("above"))
        labels = written(met.join(up, "label").select("node", "old", F.col("above").alias("label")), "labels")
        if labels.where("old <> label").isEmpty():
            return labels.select("node", "label")
