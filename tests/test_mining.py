"""Mining in rounds equals mining all logs at once; what a round reads and replaces."""

import random

from loomspark.operators.mining import HardExamples, hard_cases
from loomspark.sources.work import Work
from pyspark.sql import functions as F

SCHEMA = "at int, pass_at_1 boolean, prompt string, tests string, test_quality_score double, error_type string, hardness double"


def logs(spark, seed, n=300):
    r = random.Random(seed)
    rows = [(i, r.choice([True, False, None]), r.choice(["a", "b", "c ", " ", None]) , f"t{r.randrange(30)}", r.choice([0.5, 1.0, 3.0, None]), r.choice("xyz"), r.random()) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_rounds_in_any_order_and_twice(spark):
    every = logs(spark, 1)
    want = {(r.task_key, r["at"]) for r in hard_cases(every, "at").collect()}
    tables = []
    for order in ((0, 1, 2), (2, 1, 0)):
        kept = HardExamples(spark, Work(spark, "mining-test").held(), "at", parts=4)
        for k in order:
            assert kept.mine(every.where(F.col("at") % 3 == k), f"r{k}")
        assert not kept.mine(every.where("at % 3 = 1"), "r1")
        tables.append({(r.task_key, r["at"]) for r in kept.examples().collect()})
        assert kept.examples().count() == len(want)
    assert tables == [want, want]
    kept.spark.createDataFrame([("other",)], "round_id string").write.mode("overwrite").parquet(f"{kept.root}/rounds")
    assert kept.mine(every.where("at % 3 = 1"), "r1")  # as after a round that broke off before it was noted
    assert {(r.task_key, r["at"]) for r in kept.examples().collect()} == want


def test_only_touched_parts_are_replaced(spark):
    kept = HardExamples(spark, Work(spark, "mining-test").held(), "at", parts=16)
    kept.mine(logs(spark, 2), "first")
    files = lambda: {r[0] for r in spark.read.parquet(f"{kept.root}/examples").select(F.input_file_name()).distinct().collect()}
    before = files()
    kept.mine(spark.createDataFrame([(-1, False, "new task", "t", 2.0, "x", 0.5)], SCHEMA), "second")
    changed = files() ^ before
    assert len({f.split("part=")[1].split("/")[0] for f in changed}) == 1 and len(before & files()) >= len(before) - 1


def test_share(spark):
    kept = HardExamples(spark, Work(spark, "mining-test").held(), "at", parts=2)
    kept.mine(logs(spark, 3), "r")
    n = kept.examples().count()
    counts = {r[0]: r[1] for r in kept.selected("error_type", 0.2, "hardness").groupBy("error_type").count().collect()}
    assert counts and max(counts.values()) <= max(1, int(n * 0.2))
