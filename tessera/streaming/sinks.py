"""Sinks of streams that may run a batch twice: each is a function of (batch, batch_id) for foreachBatch, keyed by the batch's number.

    errors.writeStream.foreachBatch(fan_out(table_sink(path), alert_sink(notify, alerts_path))).option("checkpointLocation", at).start()
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession

Sink = Callable[[DataFrame, int], None]


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def table_sink(path: str, kind: str = "parquet", options: dict[str, str] | None = None) -> Sink:
    """Adds each batch to a table once, in a folder of its own, batch_id=N, which reads as a column.

    A batch whose folder is complete (has its success mark) is passed over, so a replay adds nothing; one that was cut short is written anew. Readers see whole batches or none of one's
    rows twice, as long as they read the table by its folders' marks or after the batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        at = f"{path}/batch_id={batch_id}"
        if not exists(batch.sparkSession, f"{at}/_SUCCESS"):
            batch.write.mode("overwrite").format(kind).options(**(options or {})).save(at)

    return write


def complete(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    """The rows of a table_sink()'s complete batches; None if there is none."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    done = [s.getPath().toString() for s in fs.listStatus(at) if s.isDirectory() and exists(spark, f"{s.getPath()}/_SUCCESS")]
    return spark.read.format(kind).option("basePath", path).load(done) if done else None


def alert_sink(notify: Callable[[int, Iterator[Row]], None], path: str, kind: str = "parquet") -> Sink:
    """Tells of a batch's alerts: they are kept in a table_sink() first, then notify(batch_id, rows) runs where the rows are, once for each partition that has any, and the batch is marked as told.

    A replay of a batch that was told tells nothing. If it breaks off between the two, the batch is told again from the table, so a receiver that must not hear twice keeps batch_id. Cool-downs belong
    before the sink (windows.alerts_stream), where they hold across batches.
    """
    keep = table_sink(path, kind)

    def told(batch_id: int, rows: Iterator[Row]) -> None:
        first = next(rows, None)
        if first is not None:
            notify(batch_id, _chained(first, rows))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = f"{path}/batch_id={batch_id}"
        if exists(spark, f"{at}/_TOLD"):
            return
        keep(batch, batch_id)
        spark.read.schema(batch.schema).format(kind).load(at).foreachPartition(lambda rows: told(batch_id, rows))
        fs, mark = _fs(spark, f"{at}/_TOLD")
        fs.create(mark, True).close()

    return write


def _chained(first: Row, rows: Iterator[Row]) -> Iterator[Row]:
    yield first
    yield from rows


def fan_out(*sinks: Sink) -> Sink:
    """One batch to several sinks, in order; it is computed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks:
                sink(held, batch_id)
        finally:
            held.unpersist()

    return write
