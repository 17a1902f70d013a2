"""The quota loop: candidates are taken in order until enough are accepted or enough were looked at; then the graph is expanded.

Where acceptance is a function of the row, the loop is a running count: a candidate is evaluated while fewer than `target`
were accepted before it and fewer than `depth` were looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fuse import keep_first
from .lineage import checkpointed, unused
from .screen import worth_evaluating

TARGET, DEPTH, FLOOR = 20, 100, 3.0


def one_round(queue: DataFrame, accepted: Column, run: str = "run_id", rank: str = "rank", key: str = "id", target: int = TARGET, depth: int = DEPTH, floor: float = FLOOR, score: str = "abstract_relevance_score") -> DataFrame:
    """Rows of each run's queue that are looked at: position, evaluated, accepted. Repeats of a key are looked at, not evaluated."""
    # Only a run's first `depth` rows can matter; tasks cut to them before the shuffle.
    rows = queue.withColumn("position", F.row_number().over(Window.partitionBy(run).orderBy(rank))).filter(F.col("position") <= depth)
    first, before = unused(rows, "first"), unused(rows, "before")
    rows = rows.withColumn(first, F.row_number().over(Window.partitionBy(run, key).orderBy("position")) == 1)
    worth = F.col(first) & worth_evaluating(F.col(score), floor) if score in queue.columns else F.col(first)
    rows = rows.withColumn("evaluated", worth).withColumn("accepted", F.coalesce(worth & accepted, F.lit(False)))
    earlier = Window.partitionBy(run).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(before, F.coalesce(F.sum(F.col("accepted").cast("int")).over(earlier), F.lit(0)))
    return rows.filter(F.col(before) < target).drop(before, first)


def loop(queue: DataFrame, accept: Callable[[DataFrame], Column], expand: Callable[[DataFrame, DataFrame], DataFrame] | None = None, target: int = TARGET, depth: int = DEPTH, run: str = "run_id", key: str = "id", keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """Rounds of evaluation; whenever the queue is empty and the quota isn't met, expand(accepted, seen) makes the next one.

    A round looks at a new row or is the last, so depth bounds the rounds. keep writes and rereads what a round adds and the
    counts so far, one row a run, without which plans grow by the round (cluster jobs pass one that uses the shared folder).
    No round writes an earlier one's rows again.
    """
    counted = lambda d: d.groupBy(run).agg(F.sum(F.col("accepted").cast("int")).alias("a"), F.count(F.lit(1)).alias("n"))
    seen = keep(one_round(queue, accept(queue), run=run, key=key, target=target, depth=depth))
    counts = keep(counted(seen)) if expand else None
    while expand:
        short = counts.filter((F.col("a") < target) & (F.col("n") < depth))
        if short.isEmpty():
            break
        new = expand(seen.filter("accepted"), seen)
        a, n, got = unused(new, "a"), unused(new, "n"), unused(new, "got")
        new = new.join(short.withColumnsRenamed({"a": a, "n": n}), run)
        fresh = new.join(seen.select(run, key).distinct(), [run, key], "left_anti")
        fresh = keep_first(fresh, [run, key], [F.col("rank")])
        more = one_round(fresh, accept(fresh), run=run, key=key, target=1 << 30, depth=depth)
        earlier = Window.partitionBy(run).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        more = more.withColumn(got, F.coalesce(F.sum(F.col("accepted").cast("int")).over(earlier), F.lit(0)) + F.col(a)).withColumn("position", F.col("position") + F.col(n))
        more = keep(more.filter((F.col(got) < target) & (F.col("position") <= depth)).drop(got, a, n))
        if more.isEmpty():
            break
        counts = keep(counts.unionByName(counted(more)).groupBy(run).agg(F.sum("a").alias("a"), F.sum("n").alias("n")))
        seen = seen.unionByName(more, allowMissingColumns=True)
    return seen


def counters(seen: DataFrame, run: str = "run_id") -> DataFrame:
    """run, looked_at, evaluated, accepted, pruned: what a loop's rows come to."""
    n = lambda c: F.sum(F.col(c).cast("long"))
    return seen.groupBy(run).agg(F.count(F.lit(1)).alias("looked_at"), n("evaluated").alias("evaluated"), n("accepted").alias("accepted"), (n("evaluated") - n("accepted")).alias("pruned"))
