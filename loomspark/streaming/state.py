"""Operators whose state outlives a micro-batch: repeats of a fingerprint, and the best score so far.

Both are the streaming forms of windows over all rows of a key in order of arrival
(``rewards.diversity_reward``, ``ranking.stagnation``): what such a window would know of earlier
rows is kept as a small table and carried from batch to batch by ``transformWithState``. A key of
the state is one of some parts of the keys' hashes, so a call works on thousands of rows as
arrays. Rows behind the watermark are late and don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Parts of the keys' hashes.
PARTS = 64


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose state store is the one that transformWithState needs; stores are closed after each batch."""
    own = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(k, spark.conf.get(k))
    store = "spark.sql.streaming.stateStore"
    own.conf.set(f"{store}.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set(f"{store}.unloadOnCommit", "true")
    own.conf.set(f"{store}.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set(f"{store}.rocksdb.allowFAllocate", "false")
    own.conf.set(f"{store}.rocksdb.writeBufferSizeMB", "4")
    return own


class TableState(StatefulProcessor):
    """Per key of the state a table, by ``key`` columns, as one Arrow block; ``kept``: its other columns and their types."""

    kept: dict[str, pa.DataType] = {}

    def __init__(self, key: list[str], order: list[str], keep_ms: int | None):
        self.key, self.order, self.keep_ms = key, order, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("table", "block binary")

    def load(self, rows: pd.DataFrame) -> pd.DataFrame:
        if not self.state.exists():
            return rows[self.key].head(0).assign(**{c: pd.Series(dtype=t.to_pandas_dtype()) for c, t in {**self.kept, "met": pa.int64()}.items()})
        with pa.ipc.open_stream(self.state.get()[0]) as stream:
            return stream.read_pandas()

    def store(self, table: pd.DataFrame, watermark: int) -> None:
        """Keys that weren't met for ``keep_ms`` before the watermark are forgotten."""
        if self.keep_ms is not None:
            table = table[table["met"] >= watermark - self.keep_ms]
        if not len(table):
            self.state.clear()
            return
        sink = pa.BufferOutputStream()
        block = pa.Table.from_pandas(table[[*self.key, *self.kept, "met"]], preserve_index=False)
        with pa.ipc.new_stream(sink, block.schema) as stream:
            stream.write_table(block)
        self.state.update((sink.getvalue().to_pybytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat([r for r in rows], ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)
        watermark = timerValues.getCurrentWatermarkInMs() if self.keep_ms is not None else 0
        before = self.load(rows)
        if self.keep_ms is not None:
            before = before[before["met"] >= watermark - self.keep_ms]
        out, after = self.advance(rows.merge(before, on=self.key, how="left", suffixes=("", "_before")))
        met = rows.assign(met=rows["event_ms"]).groupby(self.key, as_index=False)["met"].max()
        after = after.merge(met, on=self.key)
        known = pd.concat([before, after], ignore_index=True).groupby(self.key, as_index=False)
        self.store(known.last().merge(known["met"].max(), on=self.key, suffixes=("_", "")), watermark)
        yield out

    def advance(self, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """From rows in order, with their key's state: what they give, and the state of their keys afterwards."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Repeats(TableState):
    kept = {"times": pa.int64()}

    def advance(self, rows):
        earlier = rows["times"].fillna(0).astype("int64")
        rows["seen"] = earlier + rows.groupby(self.key).cumcount()
        after = (rows.groupby(self.key)["seen"].max() + 1).rename("times").reset_index()
        return rows.drop(columns=["times", "met"]), after


class Best(TableState):
    kept = {"best": pa.float64(), "stale": pa.int64()}

    def advance(self, rows):
        groups = rows.groupby(self.key)
        running = groups["score"].cummax().groupby([rows[k] for k in self.key]).shift()
        rows["best_before"] = np.fmax(running.to_numpy(float), rows["best"].to_numpy(float))
        improved = rows["best_before"].isna() | (rows["score"] > rows["best_before"])
        rows["improved"] = improved
        island = improved.astype(int).groupby([rows[k] for k in self.key]).cumsum()
        since = rows.assign(_i=island).groupby([*self.key, "_i"]).cumcount()
        # before the first improvement of this batch the earlier batches' count goes on
        rows["stale_rounds"] = np.where(island == 0, rows["stale"].fillna(0).astype("int64") + since + 1, since)
        after = groups.agg(top=("score", "max"), best=("best", "first")).reset_index()
        after["best"] = np.fmax(after["top"].to_numpy(float), after["best"].astype(float).to_numpy())
        after = after.drop(columns="top").merge(rows.groupby(self.key)["stale_rounds"].last().rename("stale").reset_index(), on=self.key)
        return rows.drop(columns=["best", "stale", "met"]), after


def carried(rows: DataFrame, kind: type[TableState], key: list[str], order: list[str], time: str, delay: str, added: str, keep_ms: int | None = None) -> DataFrame:
    """rows (a stream) with what the state of their key adds, in order of arrival; late rows, a watermark of ``delay`` behind, are left out.

    The result has the columns of rows and ``added``; key columns are not null, and no name begins with an underscore,
    as Spark renames such columns on their way to the processor.
    """
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(added).fields])
    names = schema.fieldNames()

    class Selected(kind):
        def handleInputRows(self, key, rows, timerValues):
            for out in super().handleInputRows(key, rows, timerValues):
                yield out[names]

    at = F.col(time).cast("timestamp")
    marked = rows.withColumns({"event_at": at, "event_ms": F.unix_millis(at), "state_part": F.pmod(F.xxhash64(*key), F.lit(PARTS)).cast("int")})
    return marked.withWatermark("event_at", delay).groupBy("state_part").transformWithStateInPandas(Selected(key, order, keep_ms), schema, "Append", "EventTime")


def repeats(rows: DataFrame, key: list[str], order: list[str], time: str, delay: str, keep_ms: int | None = None) -> DataFrame:
    """rows with ``seen``: how many rows of the same key came before, in this batch or an earlier one."""
    return carried(rows, Repeats, key, order, time, delay, "seen long", keep_ms)


def stagnation(rows: DataFrame, key: list[str], order: list[str], score: str, patience: int, time: str, delay: str, keep_ms: int | None = None) -> DataFrame:
    """rows with the best score before them, whether they improve on it, the rows since one last did, and whether to stop."""
    out = carried(rows.withColumn("score", F.col(score).cast("double")), Best, key, order, time, delay, "best_before double, improved boolean, stale_rounds long", keep_ms)
    return out.withColumn("stop", F.col("stale_rounds") >= patience)


def feed(batches: DataFrame, number: str, stream, spark: SparkSession, root: str, total: int) -> DataFrame:
    """Runs a stateful stream over numbered batches, as a log that grows would: each batch's files are moved to where the stream
    looks, and the query starts anew on one checkpoint. stream: from the streamed rows to the result, which is read back."""
    schema = StructType([f for f in batches.schema.fields if f.name != number])
    batches.write.partitionBy(number).parquet(f"{root}/cut")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in ("fed", "told"):
        files.mkdirs(path(f"{root}/{name}"))
    own = stateful_session(spark)
    out = None
    for k in range(total):
        if files.exists(path(f"{root}/cut/{number}={k}")):
            files.rename(path(f"{root}/cut/{number}={k}"), path(f"{root}/fed/{k}"))
        out = stream(own.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/fed"))
        out.writeStream.format("parquet").option("path", f"{root}/told").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/told")
