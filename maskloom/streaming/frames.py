"""Frames and offers as streams: stateless records, contiguous order, repeats, live metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators import masks, objects, reports
from ..sources.shared import fresh_path


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class TableSink:
    """Writes each batch of a stream under its number, so a batch that is replayed after a failure replaces itself.

    A subclass can change what is stored by its `commit`; it is called once per batch, and again with the same
    number if the batch is replayed.
    """

    def __init__(self, path: str, keep: str = "append"):
        self.path, self.keep = path, keep

    def commit(self, batch: DataFrame, number: int) -> None:
        """Every batch stays (`append`), or only the last one (`complete`)."""
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number if self.keep == 'append' else 0}")

    def rows(self, spark: SparkSession, schema) -> DataFrame:
        names = [f.name for f in schema.fields]
        return spark.read.option("basePath", self.path).schema(schema).parquet(self.path).select(*names)


def drive(stream: DataFrame, sink: TableSink, mode: str, log: str, once: bool = False) -> None:
    """Run a stream over what is there. log: the folder of the stream's progress; with it a restart goes on where it stopped.

    once: in one batch, after which timers wait for the next run. Spark goes on with batches as long as there are timers of processing time.
    """
    query = stream.writeStream.outputMode(mode).foreachBatch(sink.commit).option("checkpointLocation", log).trigger(**{"once" if once else "availableNow": True}).start()
    query.awaitTermination()


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drive a stream over what is there and return what its sink holds, a table of the shared folder."""
    spark = stream.sparkSession
    sink = TableSink(fresh_path(spark, "stream-out"), mode)
    drive(stream, sink, mode, fresh_path(spark, "stream-log"))
    return sink.rows(spark, stream.schema)


def frame_records(frames: DataFrame) -> DataFrame:
    """The per-frame job, the same on a stream and on a table."""
    return reports.frame_ids(frames).select("stream_id", "frame_idx", "frame_id", "outcome", F.when(F.col("outcome") == "success", "kept").otherwise("dropped").alias("fate"))


class ObjectSink(TableSink):
    """Runs the per-frame mask job on each batch of frames, and stores the objects of its frames.

    Frames meet their candidates and runs, which are tables, image by image; a frame's objects do not depend on the batch that it comes in.
    runs: see frame_objects.
    """

    def __init__(self, path: str, cand: DataFrame, runs: DataFrame | Callable[[DataFrame], DataFrame], limits: dict):
        super().__init__(path)
        self.cand, self.runs, self.limits = cand, runs, limits

    def commit(self, batch: DataFrame, number: int) -> None:
        super().commit(frame_objects(batch, self.cand, self.runs, self.limits), number)


def frame_objects(frames: DataFrame, cand: DataFrame, runs: DataFrame | Callable[[DataFrame], DataFrame], limits: dict) -> DataFrame:
    """The objects of each frame in final order: measured, filtered, numbered. frames: image_id, stream_id, frame_idx, frame_id.

    runs: a table of runs, or what measures candidates where they are (empty masks with area 0): runs are not moved then.
    """
    named = frames.select("image_id", "stream_id", "frame_idx", "frame_id")
    images = named.select("image_id").distinct()
    here = lambda df: df.join(images.hint("merge"), "image_id", "left_semi")
    measured = runs(here(cand)) if callable(runs) else objects.with_measures(here(cand), masks.measure_masks(here(runs)))
    judged = objects.filter_geometry(measured, limits)
    kept = objects.order_objects(objects.assign_filtered_index(judged.filter("reason IS NULL")))
    return named.join(kept.hint("merge"), "image_id").select("stream_id", "frame_idx", "frame_id", "image_id", "source_index", "instance_id", "label", "area")


class InOrder(StatefulProcessor):
    """Of each stream, the next index to give out as a value, the frames that wait for it as a map, and a timer."""

    def __init__(self, timeout_ms: int | None):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "idx long")
        self.waiting = handle.getMapState("waiting", "idx long", "frame_id string")

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"stream_id": pd.Series([key[0]] * len(out), dtype="int64"), "frame_idx": pd.Series([r[0] for r in out], dtype="int64"), "frame_id": pd.Series([r[1] for r in out], dtype="object"), "fate": pd.Series([r[2] for r in out], dtype="object")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        nxt = self.next.get()[0] if self.next.exists() else 1
        for batch in rows:
            out, new, some_wait = [], {}, self.waiting.exists()
            for idx, frame in zip(batch["frame_idx"].tolist(), batch["frame_id"].tolist(), strict=True):
                if idx < nxt or idx in new or (some_wait and self.waiting.containsKey((idx,))):
                    out.append((idx, frame, "late"))
                else:
                    new[idx] = frame
            # Of what waits only the frames that are given out now are read, and removed; the others stay untouched.
            while True:
                if nxt in new:
                    out.append((nxt, new.pop(nxt), "in_order"))
                elif some_wait and self.waiting.containsKey((nxt,)):
                    out.append((nxt, self.waiting.getValue((nxt,))[0], "in_order"))
                    self.waiting.removeKey((nxt,))
                else:
                    break
                nxt += 1
            for idx, frame in new.items():
                self.waiting.updateValue((idx,), (frame,))
            if out:
                yield self._frame(key, out)
        self.next.update((nxt,))
        if self.timeout_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What waits is given out over the gaps, in order, and the frames lost are late from now on."""
        idx = sorted(k[0] for k in self.waiting.keys())
        for at in range(0, len(idx), 10_000):
            yield self._frame(key, [(k, self.waiting.getValue((k,))[0], "after_gap") for k in idx[at : at + 10_000]])
        if idx:
            self.waiting.clear()
            self.next.update((idx[-1] + 1,))

    def close(self) -> None:
        pass


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def ordered_emit(stream: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Frames of each stream in contiguous order from 1, whatever order they arrive in; `fate` tells how each came out.

    `in_order`: with all before it. With a timeout, what waits is given out once a stream is silent so long, `after_gap`, so lost
    frames do not keep it for ever. A frame that comes after its place was passed, or again, is `late`: no frame is without a row.
    A batch reads and writes the state of its own frames only, however many wait. stream: stream_id, frame_idx, frame_id.
    """
    # Map state and timers need this store; it is read when the stream starts.
    stream.sparkSession.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.groupBy("stream_id").transformWithStateInPandas(InOrder(timeout_ms), "stream_id long, frame_idx long, frame_id string, fate string", "append", "ProcessingTime" if timeout_ms else "None")


def idempotent_offers(stream: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """The first offer of each name; repeats are silent, whatever they say (see contradictory_offers).

    The watermark only lets old names be forgotten: a name offered again after that is new, and an offer older than the watermark is dropped.
    stream: ts, request_id, name, stage, raw_bytes.
    """
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["request_id", "name"])


def contradictory_offers(stream: DataFrame, again: DataFrame, minutes: int = 10) -> DataFrame:
    """Offers of a name that contradict its first one in stage or size, each once, beside what the first one said.

    stream and again: the same offers, read twice (a stream meets its own first offers by a join within the watermark).
    """
    first = idempotent_offers(stream, f"{minutes} minutes").select(F.col("ts").alias("first_ts"), F.col("request_id").alias("first_request"), F.col("name").alias("first_name"), F.col("stage").alias("first_stage"), F.col("raw_bytes").alias("first_bytes"))
    later = again.withWatermark("ts", f"{minutes} minutes")
    near = (F.col("ts") >= F.col("first_ts") - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("ts") <= F.col("first_ts") + F.expr(f"INTERVAL {minutes} MINUTES"))
    same = F.col("request_id").eqNullSafe(F.col("first_request")) & F.col("name").eqNullSafe(F.col("first_name"))
    other = ~(F.col("stage").eqNullSafe(F.col("first_stage")) & F.col("raw_bytes").eqNullSafe(F.col("first_bytes")))
    return later.join(first, same & near & other).select("request_id", "name", "stage", "raw_bytes", "first_stage", "first_bytes")


def live_metrics(stream: DataFrame, value: str = "ms", bounds: tuple[float, ...] = (1, 2.5, 10, 50), order: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """Running counters, cumulative histogram and gauges per stream: the columns of the batch reports."""
    return stream.groupBy("stream_id").agg(*reports.counter_columns(), *reports.histogram_columns(value, list(bounds)), *reports.gauge_columns(list(order), value))
