"""Tree search over rounds of candidates: beams, stops, winners and their paths.

Each round joins its candidates to the beam that the round before has kept, ranks them per case,
ends cases that have passed, run dry or not improved for too long, and keeps the best of different
code as the next beam. A round reads its own candidates only and writes its beam, so lineage and
work are those of one round; the loop's length is the number of rounds, not of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import strip
from loomspark.sources.work import Work


def best_first() -> list[Column]:
    """The order in which candidates of a round are taken; ties go to the smaller node."""
    return [F.desc("node_score"), F.desc("score"), F.asc("exec_time"), F.asc("node")]


def tree_search(candidates: DataFrame, rounds: int, width: int = 2, patience: int = 0) -> tuple[DataFrame, DataFrame]:
    """The outcome of each case, and the path to each case's winner.

    candidates: case, round (from 1), node, parent (null in round 1), code, node_score, score, exec_time and all_passed; a node
    is named once in a case's round. A case ends with its first round that has a passed candidate; the winner is then the
    best of the passed ones, else the best of all rounds, the earlier of equal ones. patience: rounds without a better
    best after which a case stops, if positive. Outcome: case, status, round and node of the winner, n_rounds that ran.
    Path: case, round, node, from round 1 to the winner.
    """
    work = Work(candidates.sparkSession, "tree-search")
    names = ["case", "round", "node", "parent", "code", "node_score", "score", "exec_time", "all_passed"]
    candidates.select(*names).write.partitionBy("round").parquet(work.path("candidates"))
    schema = candidates.select(*names).schema
    own = work.spark.read.schema(schema).parquet(work.path("candidates"))
    beam = None
    ended: list[DataFrame] = []
    ran = 0
    for k in range(1, max(rounds, 1) + 1):
        live = own.where(F.col("round") == k)
        if beam is not None:
            kept = beam.where("going").select(F.col("case").alias("_case"), F.col("node").alias("_node"), "best", "best_round", "best_node", "stale")
            live = live.join(kept, (F.col("case") == F.col("_case")) & (F.col("parent") == F.col("_node"))).drop("_case", "_node")
        else:
            live = live.where("parent IS NULL").withColumns({"best": F.lit(None).cast("double"), "best_round": F.lit(None).cast("int"), "best_node": F.lit(None).cast(schema["node"].dataType), "stale": F.lit(0)})
        ranked = Window.partitionBy("case").orderBy(*best_first())
        whole = Window.partitionBy("case")
        live = live.withColumn("place", F.row_number().over(ranked))
        top = F.max(F.when(F.col("place") == 1, F.struct("node_score", "node"))).over(whole)
        winner = F.min(F.when(F.coalesce("all_passed", F.lit(False)), F.struct("place", "node"))).over(whole)
        live = live.withColumns({"top": top, "passed_node": winner["node"]})
        better = F.col("best").isNull() | (F.col("top.node_score") > F.col("best"))
        live = live.select(
            *names, "place", "passed_node", F.when(better, F.col("top.node_score")).otherwise(F.col("best")).alias("best"), F.when(better, F.lit(k)).otherwise(F.col("best_round")).alias("best_round"),
            F.when(better, F.col("top.node")).otherwise(F.col("best_node")).alias("best_node"), F.when(better, 0).otherwise(F.col("stale") + 1).alias("stale"))
        code = strip(F.coalesce("code", F.lit(""))) != ""
        first = F.row_number().over(Window.partitionBy("case", F.sha2(F.col("code").cast("binary"), 256)).orderBy("place")) == 1
        live = live.withColumn("fit", code & first)
        rank = F.sum(F.col("fit").cast("int")).over(whole.orderBy("place"))
        going = F.col("passed_node").isNull() & (F.lit(patience <= 0) | (F.col("stale") < patience))
        live = live.withColumns({"in_beam": F.col("fit") & (rank <= max(width, 1)), "going": going}).where("in_beam OR place = 1")
        saved = work.save(live.withColumn("going", F.col("going") & F.col("in_beam")).select("case", "node", "parent", "place", "passed_node", "best", "best_round", "best_node", "stale", "going"), f"beam-{k}")
        beam, ran = saved, k
        # a case whose candidates of this round are its last ones is told by its largest round
        ended.append(saved.where("place = 1").select("case", F.lit(k).alias("n_rounds"), "passed_node", "best_round", "best_node"))
        if saved.where("going").isEmpty():
            break
    every = ended[0]
    for part in ended[1:]:
        every = every.unionByName(part)
    last = every.groupBy("case").agg(F.max_by(F.struct("n_rounds", "passed_node", "best_round", "best_node"), "n_rounds").alias("e")).select("case", "e.*")
    passed = F.col("passed_node").isNotNull()
    outcome = last.select(
        "case", F.when(passed, "passed").otherwise("failed").alias("status"), F.when(passed, F.col("n_rounds")).otherwise(F.col("best_round")).alias("round"),
        F.coalesce("passed_node", "best_node").alias("node"), "n_rounds")
    outcome = work.save(outcome, "outcome")
    return outcome, paths(own, outcome, ran, work)


def paths(candidates: DataFrame, outcome: DataFrame, rounds: int, work: Work) -> DataFrame:
    """From each winner back to round 1 by its parents, a round at a time."""
    at = outcome.select("case", "round", "node").limit(0)
    steps = None
    for k in range(rounds, 0, -1):
        here = at.unionByName(outcome.where(F.col("round") == k).select("case", "round", "node"))
        own = candidates.where(F.col("round") == k).select("case", "node", "parent")
        found = work.save(here.join(own, ["case", "node"]).select("case", F.lit(k).alias("round"), "node", "parent"), f"path-{k}")
        part = found.select("case", "round", "node")
        steps = part if steps is None else steps.unionByName(part)
        at = found.select("case", F.lit(k - 1).alias("round"), F.col("parent").alias("node"))
    return steps
