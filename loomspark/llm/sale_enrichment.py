"""Valid-time sale enrichment: each sale gets the version of its client that held when it was sold.

Sales and client changes come in numbered batches, late and out of order. A ``transformWithState``
stage of a Structured Streaming query works on them, keyed by client. It keeps clients' versions and
the sales that wait until the watermark H has passed their time of sale. In each batch it adds the
versions, answers the sales that are due, and then forgets the versions that no sale behind H can
need: of those valid up to H all but the last. The query is started anew for each batch on one
checkpoint, and its answers go through the exactly-once file sink, so a batch that an executor's loss
cut short runs again alike. Every start opens a state store in each partition of a stage, so there is
one stage and not one for sales and one for versions.

A key is one of some hundred parts of the clients' hashes: a call works on thousands of rows as
arrays. Their number follows the counted rows, and a tick a batch wakes each. A client with over
1/512 of all rows (there can be 512 at most, so that list is bounded) is split by time of validity
into slices of six hours, each in a part of its own hash, so that its versions and sales spread. A
slice answers from its own versions and reports what it holds (so many versions past H, its last
version, whether it keeps one from before H); such reports, one a batch and slice, carry a version
on to later slices that had none, tell which slice keeps the only version from before H, and sum up
the client's versions. Pruning is lazy: a key prunes with the H of the batch before when it is met
next, before anything is added, which gives the same versions.

Times travel as microseconds since 1970, missing numbers as the smallest long (which sorts as null
does, first, and is always below H).

Edge cases: sales without arrival belong to the first batch, as do rows from before the first day;
changes without valid_at are left out, as are repeated change rows; repeated sales are emitted as
often as they stand; sales without client find nothing, and a change without client is no version
of any client, but can be late; a sale without sold_at is emitted at once without a version;
``balance_cents`` is null for a balance that is null or not finite; a batch without rows still
moves H on; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .common import Workspace, read

HOUR = 3_600_000_000
MISSING = -(2**63)
#: H before there is one, and after the last batch.
BEFORE, AFTER = -(2**62), 2**62
#: Width of a slice of a client that holds over this share of all rows, and over so many rows.
SLICE, SHARE, LEAST = 6 * HOUR, 512, 10_000
#: Rows a key is to have.
KEY_ROWS = 30_000

CHANGE, SALE, TICK, WAKE = 0, 1, 2, 3
FED = "kind int, client long, slice long, split boolean, id long, at long, seq long, cents long, op string"
TOLD = "rec string, client long, slice long, split boolean, id long, at long, n_held long, change long, v_at long, cents long, op string, kept boolean, stale boolean"
NUMBERS = ("kind", "client", "slice", "split", "id", "at", "seq", "cents")


def micros(column: str) -> str:
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))"


class Clients(StatefulProcessor):
    """Keeps clients' versions and waiting sales, and answers the sales that H (``due``) has passed; prunes first with the H of the
    batch before (``past``). The state is, per key, a table of rows in order, as one Arrow block."""

    def __init__(self, past: int, due: int):
        self.past, self.due = past, due

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rows", "block binary")

    def load(self) -> pd.DataFrame:
        if not self.state.exists():
            return pd.DataFrame({c: np.empty(0, np.int64) for c in NUMBERS} | {"op": np.empty(0, object)})
        with pa.ipc.open_stream(self.state.get()[0]) as stream:
            return stream.read_pandas()

    def store(self, rows: pd.DataFrame) -> None:
        if not len(rows):
            self.state.clear()
            return
        batch = pa.RecordBatch.from_arrays([pa.array(rows[c].to_numpy(np.int64)) for c in NUMBERS] + [pa.array(rows["op"].to_list(), pa.string())], [*NUMBERS, "op"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(batch)
        self.state.update((sink.getvalue().to_pybytes(),))

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat([r for r in rows], ignore_index=True)[[*NUMBERS, "op"]]
        held = self.load()
        waiting, held = held[held["kind"] == SALE], held[held["kind"] == CHANGE]
        owner, at = held[["client", "slice"]].to_numpy(np.int64), held["at"].to_numpy(np.int64)
        last = np.ones(len(held), bool)
        last[:-1] = (owner[1:] != owner[:-1]).any(axis=1) | (at[1:] > self.past)
        held = held[(at > self.past) | last]
        versions = pd.concat([held, rows[rows["kind"] == CHANGE]], ignore_index=True)
        versions = versions.sort_values(["client", "slice", "at", "seq", "id"], kind="stable", ignore_index=True)
        sales = pd.concat([waiting, rows[rows["kind"] == SALE]], ignore_index=True)
        due = sales["at"].to_numpy(np.int64) < self.due
        self.store(pd.concat([versions, sales[~due]], ignore_index=True))
        asked = pd.concat([sales[due], rows[rows["kind"] == TICK]], ignore_index=True)
        if len(asked):
            yield self.answer(versions, asked)

    def answer(self, versions: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """Of each sale the last version up to its time; of each slice asked for, the last of all."""
        n, m = len(versions), len(asked)
        both = {c: np.concatenate([versions[c].to_numpy(np.int64), asked[c].to_numpy(np.int64)]) for c in ("client", "slice", "at")}
        tick = asked["kind"].to_numpy() == TICK
        both["at"][n:][tick] = AFTER
        order = np.lexsort((np.arange(n + m), both["at"], both["slice"], both["client"]))  # versions come first, in their order, among equal times
        client, part = both["client"][order], both["slice"][order]
        new = np.ones(n + m, bool)
        new[1:] = (client[1:] != client[:-1]) | (part[1:] != part[:-1])
        group = np.cumsum(new) - 1
        version = order < n
        place = np.maximum.accumulate(np.where(version, np.arange(n + m), -1))
        found = (place >= np.flatnonzero(new)[group]) & (client != MISSING)
        later = np.bincount(group, version & (both["at"][order] > self.past), minlength=group[-1] + 1)[group].astype(np.int64)
        earlier = np.bincount(group, version & (both["at"][order] <= self.past), minlength=group[-1] + 1)[group].astype(np.int64)
        index = np.where(found, order[np.maximum(place, 0)], -1)
        back = np.empty(n + m, np.int64)
        back[order] = np.arange(n + m)
        here = back[n:]
        index, later, earlier = index[here], later[here], earlier[here]
        none = index < 0
        taken = lambda c, to: np.where(none, to, versions[c].to_numpy()[np.maximum(index, 0)]) if n else np.full(m, to)
        v_at = taken("at", MISSING).astype(np.int64)
        split = asked["split"].to_numpy(bool)
        return pd.DataFrame({
            "rec": np.where(tick, "slice", "sale").astype(object), "client": asked["client"].to_numpy(), "slice": asked["slice"].to_numpy(), "split": split,
            "id": asked["id"].to_numpy(), "at": asked["at"].to_numpy(), "n_held": np.where(split, later, np.where(asked["client"].to_numpy() == MISSING, 0, later + earlier)),
            "change": taken("id", MISSING).astype(np.int64), "v_at": v_at, "cents": taken("cents", MISSING).astype(np.int64), "op": taken("op", None).astype(object),
            "kept": earlier > 0, "stale": ~none & (v_at <= self.past)})


class Feed:
    """The rows of both tables by batch, the watermarks, and the folders they are fed from."""

    def __init__(self, sales: DataFrame, changes: DataFrame, batches: int, hours: int, first_day: int, days: int, least: int):
        self.spark, self.batches = sales.sparkSession, batches
        self.ws = Workspace(self.spark, "sale-enrichment")
        number = lambda day: F.expr(f"cast(greatest(0, least({batches - 1}, floor((coalesce({day}, 0) - {first_day}) * {batches} / {days}))) AS int)")
        missing = lambda c: F.coalesce(F.col(c), F.lit(MISSING))
        whole = sales.select("sale_id", "client_id", "sold_at", "arrived_at"), changes.select("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance").where("valid_at IS NOT NULL")
        sold, changed = whole
        sold = sold.select(
            missing("client_id").alias("client"), missing("sale_id").alias("id"), F.coalesce(F.expr(micros("sold_at")), F.lit(MISSING)).alias("at"),
            number("unix_date(cast(arrived_at AS date))").alias("batch"))
        cents = F.expr("if(abs(balance) < 9e16D, cast(floor(100 * balance + 0.5D) AS long), NULL)")  # NaN is larger than any number
        changed = changed.distinct().select(
            missing("client_id").alias("client"), missing("change_id").alias("id"), F.expr(micros("valid_at")).alias("at"), missing("seq").alias("seq"),
            F.coalesce(cents, F.lit(MISSING)).alias("cents"), "op",
            number("(unix_date(cast(valid_at AS date)) + pmod(coalesce(crc32(cast(cast(change_id AS string) AS binary)), 0), 4))").alias("batch"))

        owners = sold.select("client").unionAll(changed.select("client")).groupBy("client").agg(F.count("*").alias("n"))
        n = {r["of"]: r["n"] for r in sold.agg(F.lit("sales").alias("of"), F.count("*").alias("n")).unionAll(changes.agg(F.lit("changes"), F.count("*"))).collect()}
        total = sum(n.values())
        heavy = [r["client"] for r in owners.where((F.col("n") >= max(least, total // SHARE)) & (F.col("client") != MISSING)).select("client").collect()]
        self.parts = max(64, total // KEY_ROWS)
        split = F.col("client").isin(heavy) if heavy else F.lit(False)
        sliced = lambda other: F.when(split & (F.col("at") != MISSING), F.floor(F.col("at") / SLICE)).when(split, -1 - F.pmod(F.xxhash64("id"), F.lit(512))).otherwise(other)
        files = max(16, total // 2_000_000)

        ticks = self.spark.range(self.parts * (batches + 1)).select(
            F.lit(MISSING).alias("client"), F.lit(0).cast("long").alias("slice"), F.lit(False).alias("split"), F.lit(MISSING).alias("id"), F.lit(MISSING).alias("at"),
            F.expr(f"cast(id DIV {self.parts} AS int)").alias("batch"), F.lit(WAKE).alias("kind"), F.expr(f"cast(id % {self.parts} AS int)").alias("part"))
        # sales without client have no versions to meet: they spread
        alone = F.when(F.col("client") == MISSING, F.pmod(F.xxhash64("id"), F.lit(1 << 20))).otherwise(0)
        cut = sold.select("client", sliced(alone).cast("long").alias("slice"), split.alias("split"), "id", "at", "batch", F.lit(SALE).alias("kind")).withColumn("part", self.part())
        none = {"seq": F.lit(MISSING), "cents": F.lit(MISSING), "op": F.lit(None).cast("string")}
        self.write(cut.coalesce(files).unionByName(ticks.coalesce(1 + self.parts * (batches + 1) // 1_000_000)).withColumns(none), "sales")
        self.ws.delete(self.ws.root, at_exit=True)
        cut = changed.select("client", sliced(F.lit(0)).cast("long").alias("slice"), split.alias("split"), "id", "at", "batch", F.lit(CHANGE).alias("kind"), "seq", "cents", "op")
        self.write(cut.coalesce(files), "changes")

        marks = []
        for name in ("sales", "changes"):
            top = {r["batch"]: r["top"] for r in self.read(name, "batch int, kind int, at long").where(F.col("kind").isin(SALE, CHANGE) & (F.col("at") != MISSING)).groupBy("batch").agg(F.max("at").alias("top")).collect()}
            marks.append([max((v for k, v in top.items() if k < b), default=None) for b in range(batches)])
        mark = lambda top: BEFORE if top is None else top - hours * HOUR
        self.late = [mark(top) for top in marks[1]] + [BEFORE]
        self.past = [min(mark(a), mark(b)) for a, b in zip(*marks, strict=True)] + [AFTER]
        if heavy:
            self.write(self.asked(), "ticks")

    def part(self) -> Column:
        return F.pmod(F.xxhash64("client", "slice"), F.lit(self.parts)).cast("int")

    def asked(self) -> DataFrame:
        """A row for each batch and slice that may hold a version: those not over at the last pruning, and the last one before."""
        at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("batch") + 1)
        cut = self.read("changes", "batch int, kind int, client long, slice long, split boolean, at long").where(F.col("split") & (F.col("at") >= at(self.late)))
        slices = cut.groupBy("client", "slice").agg(F.min("batch").alias("since"))
        each = slices.select("client", "slice", F.explode(F.sequence("since", F.lit(self.batches))).alias("batch"))
        over = (F.col("slice") + 1) * SLICE <= at([BEFORE, *self.past])
        rest = F.max(F.when(over, F.col("slice"))).over(Window.partitionBy("client", "batch"))
        live = each.withColumn("rest", rest).where(F.col("rest").isNull() | (F.col("slice") >= F.col("rest")))
        return live.select(
            "client", "slice", F.lit(True).alias("split"), F.lit(MISSING).alias("id"), F.lit(MISSING).alias("at"), "batch", F.lit(TICK).alias("kind"),
            F.lit(MISSING).alias("seq"), F.lit(MISSING).alias("cents"), F.lit(None).cast("string").alias("op"))

    def write(self, df: DataFrame, name: str) -> None:
        df.write.partitionBy("batch").parquet(f"{self.ws.root}/cut/{name}")

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.ws.root}/cut/{name}")

    def give(self, batch: int) -> None:
        """Moves a batch's files to where the query looks for them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.ws.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for name, to in (("sales", "sales"), ("changes", "changes"), ("ticks", "changes")):
            files.mkdirs(path(f"{self.ws.root}/fed/{to}"))
            cut = path(f"{self.ws.root}/cut/{name}/batch={batch}")
            if files.exists(cut):
                files.rename(cut, path(f"{self.ws.root}/fed/{to}/{name}-{batch}"))

    def session(self) -> SparkSession:
        """A session of the same application whose state store is the one that transformWithState needs."""
        own = self.spark.newSession()
        for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            own.conf.set(k, self.spark.conf.get(k))
        store = "spark.sql.streaming.stateStore"
        own.conf.set(f"{store}.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        own.conf.set(f"{store}.rocksdb.changelogCheckpointing.enabled", "true")
        own.conf.set(f"{store}.rocksdb.allowFAllocate", "false")  # else each of the many small stores reserves megabytes
        own.conf.set(f"{store}.unloadOnCommit", "true")  # else an executor keeps every store that it ever had open
        own.conf.set(f"{store}.rocksdb.writeBufferSizeMB", "4")
        own.conf.set(f"{store}.rocksdb.boundedMemoryUsage", "true")
        own.conf.set(f"{store}.rocksdb.maxMemoryUsageMB", "256")
        own.conf.set("spark.sql.streaming.minBatchesToRetain", "2")
        return own

    def run(self) -> DataFrame:
        """Feeds all batches, a start of the query for each, and returns what it wrote."""
        own = self.session()
        root = self.ws.root
        for batch in range(self.batches + 1):
            self.give(batch)
            source = lambda name, schema: own.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/fed/{name}")
            changes = source("changes", FED)
            is_late = (F.col("kind") == CHANGE) & (F.col("at") < self.late[batch])
            met = source("sales", FED + ", part int").unionByName(changes.where(~is_late & (F.col("client") != MISSING)).withColumn("part", self.part()))
            clients = Clients([BEFORE, *self.past][batch], self.past[batch])
            answers = met.groupBy("part").transformWithStateInPandas(clients, TOLD, "Append", "None")
            fields = {c: F.lit(None).cast(t) for c, t in (f.split() for f in TOLD.split(", "))}
            late = changes.where(is_late).select(*[({"rec": F.lit("late"), "id": F.col("id"), "split": F.lit(False)}.get(c, v)).alias(c) for c, v in fields.items()])
            out = answers.unionByName(late).withColumn("batch", F.lit(batch).cast("long"))
            query = out.writeStream.format("parquet").option("path", f"{root}/told").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
        return self.spark.read.schema(TOLD + ", batch long").parquet(f"{root}/told")


def resolve(told: DataFrame) -> DataFrame:
    """Answers of split clients' sales from their slices' own answers and reports."""
    key = ["batch", "client"]
    sales = told.where((F.col("rec") == "sale") & F.col("split")).drop("kept")
    said = told.where(F.col("rec") == "slice").select(*key, "slice", "n_held", "kept", F.struct("change", "v_at", "cents", "op", "stale").alias("last"))
    # a slice of which nothing is known but that sales ask for
    asked = sales.groupBy(*key, "slice").agg(F.lit(0).cast("long").alias("n_held"), F.lit(False).alias("kept")).withColumn("last", F.lit(None).cast(said.schema["last"].dataType))
    slices = said.unionByName(asked).groupBy(*key, "slice").agg(F.max("n_held").alias("n_held"), F.max("kept").alias("kept"), F.max_by("last", F.col("last").isNotNull()).alias("last"))
    whole = Window.partitionBy(*key)
    before = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    some = F.when(F.col("last.v_at") != MISSING, F.struct("slice", "last"))
    slices = slices.select(
        *key, "slice", F.last(some, ignorenulls=True).over(before).alias("prior"), F.max(F.when(F.col("kept"), F.col("slice"))).over(whole).alias("keeper"),
        (F.sum("n_held").over(whole) + F.max(F.col("kept").cast("long")).over(whole)).alias("n_all"))
    met = sales.join(slices, [*key, "slice"])
    own = F.when((F.col("v_at") != MISSING), F.struct("slice", F.struct("change", "v_at", "cents", "op", "stale").alias("last")))
    dated = F.when(F.col("at") != MISSING, F.coalesce(own, F.col("prior")))
    met = met.withColumn("a", dated).withColumn("a", F.when(~F.col("a.last.stale") | (F.col("a.slice") == F.col("keeper")), F.col("a.last")))
    return met.select("rec", "id", "batch", F.col("n_all").alias("n_held"), F.col("a.change").alias("change"), F.col("a.cents").alias("cents"), F.col("a.op").alias("op"))


def enrich_sales(
    sales: DataFrame, changes: DataFrame, batches: int = 10, hours: int = 36, first_day: int = 19723, days: int = 152, least: int = LEAST,
) -> DataFrame:
    """rec, id, batch, n_held, change_id, balance_cents and op of every sale and every late change.

    batches: into how many the days from ``first_day`` (since 1970) on are cut; hours: by which a
    watermark stays behind; least: rows from which a client can be split.
    """
    told = Feed(sales, changes, batches, hours, first_day, days, least).run()
    plain = told.where((F.col("rec") != "slice") & ~F.col("split")).select("rec", "id", "batch", "n_held", "change", "cents", "op")
    every = plain.unionByName(resolve(told))
    known: Column = F.nullif(F.col("id"), F.lit(MISSING))
    return every.select(
        "rec", known.alias("id"), "batch", "n_held", F.nullif(F.col("change"), F.lit(MISSING)).alias("change_id"), F.nullif(F.col("cents"), F.lit(MISSING)).alias("balance_cents"), "op")


def op11_sale_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_sales(read(spark, sf_dir, "sales"), read(spark, sf_dir, "client_changes"))


#: The same by batch: a version is pruned in the first batch whose H lies at or past a later version of its client that has come.
OP11_SQL = """
WITH RECURSIVE bits AS (
  SELECT change_id, CAST(change_id AS VARCHAR) AS s, 1 AS pos, CAST(4294967295 AS BIGINT) AS crc FROM (SELECT DISTINCT change_id FROM client_changes WHERE change_id IS NOT NULL)
  UNION ALL
  SELECT change_id, s, pos + 1, list_reduce([xor(crc, CAST(ascii(substr(s, pos, 1)) AS BIGINT)), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))
  FROM bits WHERE pos <= length(s)),
checks AS (SELECT change_id, xor(crc, 4294967295) % 4 AS lag FROM bits WHERE pos > length(s)),
sold AS (
  SELECT sale_id, client_id, sold_at, greatest(0, least(9, CAST(floor((coalesce(date_diff('day', DATE '1970-01-01', CAST(arrived_at AS DATE)), 0) - 19723) * 10 / 152.0) AS BIGINT))) AS b
  FROM sales),
changed AS (
  SELECT c.*, greatest(0, least(9, CAST(floor((date_diff('day', DATE '1970-01-01', CAST(c.valid_at AS DATE)) + coalesce(k.lag, 0) - 19723) * 10 / 152.0) AS BIGINT))) AS b
  FROM (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL) c LEFT JOIN checks k ON k.change_id = c.change_id),
marks AS (
  SELECT r.b, (SELECT max(sold_at) FROM sold WHERE sold.b < r.b) - INTERVAL 36 HOUR AS w_sales, (SELECT max(valid_at) FROM changed WHERE changed.b < r.b) - INTERVAL 36 HOUR AS w_changes
  FROM (SELECT unnest(range(10)) AS b) r),
h AS (SELECT b, w_changes, CASE WHEN w_sales IS NOT NULL AND w_changes IS NOT NULL THEN least(w_sales, w_changes) END AS h FROM marks),
late AS (SELECT c.change_id, c.b FROM changed c JOIN h ON h.b = c.b WHERE c.valid_at < h.w_changes),
versions AS (
  SELECT c.client_id, c.valid_at, c.seq, c.change_id, c.balance, c.op, c.b,
         coalesce((SELECT min(h.b) FROM h WHERE h.b >= c.b AND h.h >= c.valid_at), 11) AS behind
  FROM changed c JOIN h ON h.b = c.b WHERE c.client_id IS NOT NULL AND (h.w_changes IS NULL OR c.valid_at >= h.w_changes)),
kept AS (
  SELECT *, greatest(b, least(10, coalesce(min(behind) OVER (PARTITION BY client_id ORDER BY valid_at NULLS FIRST, seq NULLS FIRST, change_id NULLS FIRST ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 10))) AS until
  FROM versions),
live AS (SELECT *, unnest(range(b, until + 1)) AS e FROM kept),
held AS (SELECT client_id, e, count(*) AS n FROM live GROUP BY ALL),
latest AS (
  SELECT client_id, e, valid_at, change_id, op, CASE WHEN isfinite(balance) THEN CAST(floor(100 * balance + 0.5) AS BIGINT) END AS cents
  FROM live QUALIFY row_number() OVER (PARTITION BY client_id, e, valid_at ORDER BY seq DESC NULLS LAST, change_id DESC NULLS LAST) = 1),
emitted AS (
  SELECT s.*, CASE WHEN s.sold_at IS NULL THEN s.b ELSE coalesce((SELECT min(h.b) FROM h WHERE h.b >= s.b AND s.sold_at < h.h), 10) END AS e FROM sold s)
SELECT 'sale' AS rec, s.sale_id AS id, s.e AS batch, coalesce(n.n, 0) AS n_held, v.change_id, v.cents AS balance_cents, v.op
FROM (SELECT * FROM emitted WHERE client_id IS NOT NULL AND sold_at IS NOT NULL) s ASOF LEFT JOIN latest v ON s.client_id = v.client_id AND s.e = v.e AND s.sold_at >= v.valid_at
LEFT JOIN held n ON n.client_id = s.client_id AND n.e = s.e
UNION ALL
SELECT 'sale', s.sale_id, s.e, coalesce(n.n, 0), NULL, NULL, NULL
FROM emitted s LEFT JOIN held n ON n.client_id = s.client_id AND n.e = s.e WHERE s.client_id IS NULL OR s.sold_at IS NULL
UNION ALL
SELECT 'late', change_id, b, NULL, NULL, NULL, NULL FROM late
"""
