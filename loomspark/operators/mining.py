"""Hard examples mined round by round into a kept table.

Each round reads its own logs only: failed cases with a task and good enough tests, one for each
task. They meet what is kept of the same tasks, of which only the parts they fall into are read and
replaced (dynamic partition overwrite). The first row of a task in order of arrival stays, so rounds
can be repeated or come in another order and leave the same table; a round that is known isn't mined
again. The result then caps the share of each kind of error, hardest first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import not_blank
from loomspark.operators.dedup import keep_first, task_key
from loomspark.operators.sampling import share_cap
from loomspark.sources.readers import exists
from loomspark.sources.work import Work


def hard_cases(logs: DataFrame, order: str, min_quality: float = 1.0) -> DataFrame:
    """Failed cases of logs (pass_at_1, prompt, tests, test_quality_score, and what else they hold), the first of each task, with its key."""
    failed = ~F.coalesce("pass_at_1", F.lit(False)) & not_blank("prompt") & not_blank("tests") & (F.col("test_quality_score") >= min_quality)
    rows = logs.where(failed).withColumn("task_key", task_key(F.col("prompt"), F.col("tests")))
    return keep_first(rows, F.col("task_key"), order)


class HardExamples:
    def __init__(self, spark: SparkSession, root: str, order: str, parts: int = 32, min_quality: float = 1.0):
        """root: a folder that all executors share; order: the column of arrival; parts: of the tasks' keys, fixed with the table."""
        self.spark, self.root, self.order, self.parts, self.min_quality = spark, root.rstrip("/"), order, parts, min_quality

    def known(self, round_id: str) -> bool:
        return exists(self.spark, f"{self.root}/rounds") and not self.spark.read.parquet(f"{self.root}/rounds").where(F.col("round_id") == round_id).isEmpty()

    def examples(self) -> DataFrame:
        """All that is kept, a row for each task."""
        return self.spark.read.parquet(f"{self.root}/examples").drop("part")

    def mine(self, logs: DataFrame, round_id: str) -> bool:
        """Takes in a round's logs; False if the round is known. The round is noted last: one that broke off is done again."""
        if self.known(round_id):
            return False
        part = F.pmod(F.xxhash64("task_key"), F.lit(self.parts)).cast("int")
        work = Work(self.spark, "mining")
        new = work.save(hard_cases(logs, self.order, self.min_quality).withColumn("part", part), "new")
        if exists(self.spark, f"{self.root}/examples"):
            touched = [r[0] for r in new.select("part").distinct().collect()]  # at most as many as there are parts
            old = self.spark.read.parquet(f"{self.root}/examples").where(F.col("part").isin(touched))
            new = work.save(keep_first(old.select(*new.columns).unionByName(new), F.col("task_key"), self.order), "merged")
        new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.root}/examples")
        self.spark.createDataFrame([(round_id,)], "round_id string").coalesce(1).write.mode("append").parquet(f"{self.root}/rounds")
        work.close()
        return True

    def selected(self, by: str, share: float, score: str) -> DataFrame:
        """The kept examples, at most ``share`` of them of each ``by``, hardest first."""
        return share_cap(self.examples(), by, share, score, self.order)
