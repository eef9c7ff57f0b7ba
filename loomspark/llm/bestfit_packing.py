"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

Documents are tokenised once; those longer than a sequence are cut so that only the first
piece is shorter than a sequence. Full pieces are sequences already. The rest is dealt by
hash into blocks of a few thousand pieces, each with the sizes of the whole corpus in
small. Every block is packed by several islands: a population starts from best-fit
decreasing and shuffled variants; crossover injects whole well-filled bins of one parent
into another, removes the bins that hold their pieces twice, and best-fits the displaced
pieces. Between epochs each island takes in the elite of its neighbour. An island whose
packing meets the lower bound stops. The best island of each block wins.

Edge cases: a null text counts as empty; an empty document is the end token alone; very
long ones are cut, never shortened; repeated rows are packed each; an empty table gives
an empty result. Columns other than the id and text take no part.
"""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import ByteBPE
from .common import Workspace, read, tidy

CAPACITY = 1024
END_TOKEN = 2
BLOCK = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
CHILDREN = 10
MOST_TASKS = 20_000

_workers: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    if path not in _workers:
        _workers[path] = ByteBPE(path)
    return _workers[path]


def cut_points(n: int, capacity: int) -> list[int]:
    """Where pieces of n tokens begin and end; only the first may be short."""
    first = n - capacity * (math.ceil(n / capacity) - 1)
    return [0, *range(first, n + 1, capacity)]


def tokenised_pieces(df: DataFrame, path: str, capacity: int, end_token: int, with_ids: bool) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32 (and ids) of every piece."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = ["bigint", "int", "bigint", "bigint", "bigint"]
    if with_ids:
        names, kinds = [*names, "ids"], [*kinds, "array<int>"]

    def cut(batches):
        bpe, end = tokenizer(path), np.array([end_token], np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                docs, texts = (c.to_pylist() for c in batch.slice(at, 512).columns)
                rows = []
                for doc, ids in zip(docs, bpe.encode(texts)):
                    ids = np.concatenate((ids, end))
                    points = cut_points(len(ids), capacity)
                    for i, (a, b) in enumerate(zip(points, points[1:])):
                        rows.append((doc, i, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), *([ids[a:b].tolist()] if with_ids else [])))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            tidy()

    return df.mapInArrow(cut, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


class Packing:
    """Bins of piece numbers, best-fitted by remaining room."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] = ()):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.at_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        for b in bins:
            self.open(list(b))

    def open(self, pieces: list[int]) -> None:
        self.bins.append(pieces)
        self.room.append(self.capacity - sum(self.sizes[p] for p in pieces))
        self.file(len(self.bins) - 1)

    def file(self, b: int) -> None:
        r = self.room[b]
        if r:
            self.at_room[r].append(b)
            self.mask |= 1 << r

    def insert(self, pieces: list[int]) -> "Packing":
        """Best fit, in the order given."""
        sizes, at_room = self.sizes, self.at_room
        for p in pieces:
            s = sizes[p]
            fits = self.mask >> s
            if not fits:
                self.open([p])
                continue
            r = s + (fits & -fits).bit_length() - 1
            b = at_room[r].pop()
            if not at_room[r]:
                self.mask &= ~(1 << r)
            self.bins[b].append(p)
            self.room[b] = r - s
            self.file(b)
        return self

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then the more uneven the filling the better."""
        return -len(self.bins), sum((self.capacity - r) ** 2 for r in self.room)


def crossover(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """Whole well-filled bins of b go into a; what they displace is best-fitted."""
    order = sorted(range(len(b.bins)), key=lambda i: (b.room[i], rng.random()))
    chosen = [i for i in order[: max(1, len(order) * 2 // 3)] if rng.random() < 0.7]
    owned = set().union(*(b.bins[i] for i in chosen)) if chosen else set()
    kept, loose = [b.bins[i] for i in chosen], []
    for bin_, room in zip(a.bins, a.room):
        if owned.isdisjoint(bin_):
            if room * 50 > a.capacity and rng.random() < 0.3:
                loose += bin_  # some badly filled bins are given up as well
            else:
                kept.append(bin_)
        else:
            loose += [p for p in bin_ if p not in owned]
    loose.sort(key=lambda p: -a.sizes[p])
    return Packing(a.sizes, a.capacity, kept).insert(loose)


def decode(sizes: list[int], capacity: int, numbers: bytes) -> Packing:
    bins: dict[int, list[int]] = {}
    for p, b in enumerate(np.frombuffer(numbers, np.int32).tolist()):
        bins.setdefault(b, []).append(p)
    return Packing(sizes, capacity, list(bins.values()))


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[bytes], population: int = POPULATION, children: int = CHILDREN) -> tuple[bytes, int, float]:
    """One epoch of one island: bin numbers of its best packing, and their fitness."""
    rng = random.Random(seed)
    falling = sorted(range(len(sizes)), key=lambda p: (-sizes[p], p))
    lower = -(-sum(sizes) // capacity)
    people = [decode(sizes, capacity, e) for e in elites] or [Packing(sizes, capacity).insert(falling)]
    best = max(people, key=Packing.fitness)
    if len(best.bins) > lower:
        while len(people) < population:
            noise = sorted(falling, key=lambda p: -sizes[p] * rng.uniform(0.9, 1.0))
            people.append(Packing(sizes, capacity).insert(noise))
        for _ in range(children):
            a, b = rng.sample(people, 2)
            child = crossover(max(a, best, key=Packing.fitness) if rng.random() < 0.5 else a, b, rng)
            worst = min(range(len(people)), key=lambda i: people[i].fitness())
            if child.fitness() > people[worst].fitness():
                people[worst] = child
            best = max(people, key=Packing.fitness)
            if len(best.bins) == lower:
                break
    numbers = np.zeros(len(sizes), np.int32)
    for i, b in enumerate(best.bins):
        numbers[b] = i
    return numbers.tobytes(), *best.fitness()


def pack_documents(
    df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_token: int = END_TOKEN,
    block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for), sequence_id and offset of every piece."""
    ws = Workspace(df.sparkSession, "bestfit-packing")
    docs = df.select(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit("")))
    pieces = tokenised_pieces(docs, path, capacity, end_token, with_ids).withColumn("uid", F.monotonically_increasing_id())
    pieces = ws.save(pieces, "pieces")
    short = pieces.where(F.col("length") < capacity)
    blocks = max(1, math.ceil(short.count() / block))
    dealt = short.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"), F.struct("uid", F.col("length").cast("int").alias("length")).alias("p"))
    dealt = dealt.groupBy("block").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    dealt = ws.save(dealt.select("block", F.col("ps.uid").alias("uids"), F.col("ps.length").alias("sizes")), "blocks")

    state = dealt.select("block", "sizes", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(None).cast("array<binary>").alias("elites"))
    for epoch in range(epochs):

        def live(batches, epoch=epoch):
            for batch in batches:
                for row in batch.to_pylist():
                    seed = zlib.crc32(f"{row['block']}/{row['island']}/{epoch}".encode())
                    numbers, fewer, filled = evolve(row["sizes"], capacity, seed, row["elites"] or [])
                    yield pa.RecordBatch.from_pydict({"block": [row["block"]], "island": [row["island"]], "numbers": [numbers], "fewer": [fewer], "filled": [float(filled)]}, schema=pa.schema([("block", pa.int64()), ("island", pa.int32()), ("numbers", pa.binary()), ("fewer", pa.int32()), ("filled", pa.float64())]))

        # a number of partitions that stays: by bytes, many islands would be one task
        spread = state.select("block", "island", "sizes", "elites").repartition(min(blocks * islands, MOST_TASKS), "block", "island")
        evolved = ws.save(spread.mapInArrow(live, "block bigint, island int, numbers binary, fewer int, filled double"), f"epoch{epoch}")
        if epoch < epochs - 1:  # each island keeps its own elite and takes in its neighbour's
            theirs = evolved.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.struct(F.lit(1).alias("k"), "numbers").alias("e"))
            both = evolved.select("block", "island", F.struct(F.lit(0).alias("k"), "numbers").alias("e")).unionByName(theirs)
            both = both.groupBy("block", "island").agg(F.array_sort(F.collect_list("e")).getField("numbers").alias("elites"))
            state = both.join(dealt.select("block", "sizes"), "block")
    best = evolved.groupBy("block").agg(F.max_by("numbers", F.struct("fewer", "filled", -F.col("island"))).alias("numbers"))

    def place(batches):
        for batch in batches:
            for row in batch.to_pylist():
                numbers, sizes = np.frombuffer(row["numbers"], np.int32), np.array(row["sizes"], np.int64)
                order = np.argsort(numbers, kind="stable")
                run = np.cumsum(sizes[order]) - sizes[order]
                first = np.concatenate(([True], np.diff(numbers[order]) != 0))
                offset = run - np.maximum.accumulate(np.where(first, run, 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(row["uids"], np.int64)[order]), pa.array((row["block"] << 20) + numbers[order].astype(np.int64)), pa.array(offset)], names=["uid", "sequence_id", "offset"])

    placed = best.join(dealt, "block").select("block", "uids", "sizes", "numbers").mapInArrow(place, "uid bigint, sequence_id bigint, offset bigint")
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": -F.col("uid") - 1, "offset": F.lit(0).cast("long")}).drop("uid")
    return short.join(placed, "uid").drop("uid").unionByName(full)


def op5_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
