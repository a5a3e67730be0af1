"""Streams: incremental documents, duplicate numbers, stateless enrichment."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tillroll.sources.ingest import enrich, ingest
from tillroll.sources.receipt_text import ITEM, file_stem, parse_documents, parsed_documents
from tillroll.schema import RECEIPTS_DDL

#: Buckets of receipt numbers that a sweep keeps its marks in; part of the stored state, so it stays as it is.
BUCKETS = 512
BODY = f"date string, store string, total decimal(14,2), items {ITEM}"


def document_stream(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    df = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(path)
    return df.select(file_stem(F.col("_metadata.file_name")).alias("receipt_number"), F.col("value").alias("text"))


def ingest_stream(documents: DataFrame, target: str, rules: DataFrame, checkpoint: str) -> StreamingQuery:
    """Append new receipts and lines; the stored receipts decide what is new.

    A batch that is repeated after a failure writes to the same batch folder again, so it
    neither loses nor doubles a receipt.
    """
    spark = documents.sparkSession
    spark.createDataFrame([], RECEIPTS_DDL).write.mode("append").parquet(f"{target}/receipts/batch=-1")

    def load(batch: DataFrame, number: int) -> None:
        parsed = parse_documents(batch)
        known = spark.read.parquet(f"{target}/receipts").where(F.col("batch") != number).drop("batch")
        receipts, items = ingest(parsed_documents(parsed), known, rules,
                                 F.when(F.col("quantity_unit") != "unknown", "parser").otherwise("derived"))
        items.write.mode("overwrite").parquet(f"{target}/items/batch={number}")
        receipts.write.mode("overwrite").parquet(f"{target}/receipts/batch={number}")

    return documents.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class FirstDocuments(StatefulProcessor):
    """The first readable document of every receipt number of a bucket; its state is the marks of the numbers that came.

    A call between Spark and Python costs more than a number, so a bucket's marks are one value, read
    and written once a batch. With `retain_ms` a mark goes so long after its number was last seen, by one
    timer a bucket for its oldest mark; else it stays. A mark that is due counts until the batch's rows are done.
    """

    def __init__(self, retain_ms: int | None = None):
        self.retain_ms = retain_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("marks", "marks binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        least: dict[str, str] = {}
        for part in rows:
            for number, body in zip(part["receipt_number"], part["body"]):
                if number not in least or body < least[number]:
                    least[number] = body
        marks = self._marks()
        first = [number for number in least if number not in marks]
        if self.retain_ms is not None:
            now = timerValues.getCurrentProcessingTimeInMs()
            self._keep(marks | dict.fromkeys(least, now), marks)
        elif first:
            self._keep(marks | dict.fromkeys(first, int(time.time() * 1000)), marks)
        if first:
            yield pd.DataFrame({"receipt_number": first, "body": [least[number] for number in first]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        marks = self._marks()
        due = max(timerValues.getCurrentProcessingTimeInMs() - 1, expiredTimerInfo.getExpiryTimeInMs())
        self._keep({number: at for number, at in marks.items() if at + self.retain_ms > due}, {})  # the timer that fired is gone
        return iter(())

    def close(self) -> None:
        pass

    def _marks(self) -> dict[str, int]:
        """Receipt numbers with the time they were last seen."""
        if not self.seen.exists():
            return {}
        table = pa.ipc.open_stream(self.seen.get()[0]).read_all()
        return dict(zip(table.column("number").to_pylist(), table.column("at").to_pylist()))

    def _keep(self, marks: dict[str, int], before: dict[str, int]) -> None:
        if marks:
            table = pa.table({"number": pa.array(marks.keys(), pa.string()), "at": pa.array(marks.values(), pa.int64())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            self.seen.update((sink.getvalue().to_pybytes(),))
        else:
            self.seen.clear()
        if self.retain_ms is not None:
            old, new = (min(m.values(), default=None) for m in (before, marks))
            if old != new:
                if old is not None:
                    self.handle.deleteTimer(old + self.retain_ms)
                if new is not None:
                    self.handle.registerTimer(new + self.retain_ms)


def sweep_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB; the given one is left as it is.

    Batches without data are off: with timers a run over what is available would not end. Timers that
    are due fire with the next batch.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        session.conf.set(name, spark.conf.get(name))
    return session


def sweep(documents: DataFrame, target: str, rules: DataFrame, checkpoint: str, retain_ms: int | None = None) -> StreamingQuery:
    """Append the receipts of what a folder holds by now; the stream's own state decides what is new.

    `documents` is a stream (receipt_number, text) of a `sweep_session`, `rules` a table of the same.
    No batch reads what is stored, but for the marks in the buckets of the numbers that arrive. An unreadable document leaves no
    mark, and a readable one of its number counts later. Of several in a batch the smallest by
    content stays. A batch that runs again writes to its own folder again.
    """
    spark = documents.sparkSession
    readable = parse_documents(documents).where("status = 'ok' AND receipt_number IS NOT NULL").select(
        F.pmod(F.xxhash64("receipt_number"), F.lit(BUCKETS)).alias("bucket"), "receipt_number",
        F.to_json(F.struct("date", "store", "total", "items")).alias("body"))
    first = readable.groupBy("bucket").transformWithStateInPandas(
        FirstDocuments(retain_ms), "receipt_number string, body string", "append", "processingTime" if retain_ms is not None else "None")

    def load(batch: DataFrame, number: int) -> None:
        fresh = batch.select("receipt_number", F.from_json("body", BODY).alias("d")).select("receipt_number", "d.*")
        none = spark.createDataFrame([], RECEIPTS_DDL)
        receipts, items = ingest(fresh, none, rules, F.when(F.col("quantity_unit") != "unknown", "parser").otherwise("derived"))
        items.write.mode("overwrite").parquet(f"{target}/items/batch={number}")
        receipts.write.mode("overwrite").parquet(f"{target}/receipts/batch={number}")

    return first.writeStream.foreachBatch(load).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_repeats(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """First row of every key; state is dropped once the watermark has passed."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def enrich_stream(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Price model and category of streamed lines against static rules."""
    return enrich(lines, rules)


def run_to_end(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Drain what is available into a table and read it."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option(
        "checkpointLocation", f"{folder}/{name}-log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}")
