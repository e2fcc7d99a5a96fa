"""Runs of paid calls as tables: what is still to be sent, what the budget admits, what was paid, and what segments got.

Attempts are rows known by (key, attempt): writing them again changes nothing, so a task that runs twice pays once. Calls are
admitted in the order of their keys by a running sum of the most they may cost; no task sees all calls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.written import written
from .ordered import running

#: Attempts of a call at most: one, and one more where its answer isn't valid.
ATTEMPTS = 2


def worst_cost(chars: Column, prices: dict[str, float], most_output: int) -> Column:
    """The most a call may cost, in dollars: a token per three characters, nothing cached, the output at its full length."""
    return (chars / 3 * max(prices["input"], prices.get("written", 0.0)) + most_output * prices["output"]) / 1e6


def pending(calls: DataFrame, attempts: DataFrame) -> DataFrame:
    """calls (key, ...) with the number of their next attempt: those without a valid answer that have tries left."""
    known = attempts.groupBy("key").agg(F.countDistinct("attempt").alias("sent"), F.bool_or("ok").alias("answered"))
    rest = calls.join(known, "key", "left").where(~F.coalesce("answered", F.lit(False)) & (F.coalesce("sent", F.lit(0)) < ATTEMPTS))
    return rest.withColumn("attempt", (F.coalesce("sent", F.lit(0)) + 1).cast("int")).drop("sent", "answered")


def spent(attempts: DataFrame) -> DataFrame:
    """One row, spent: every attempt counts once."""
    return attempts.groupBy("key", "attempt").agg(F.max("cost").alias("cost")).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("spent"))


def admitted(waiting: DataFrame, paid: DataFrame, cap: float, run_cap: float | None = None, run_paid: DataFrame | None = None) -> DataFrame:
    """waiting (key, worst, ...) with reserved, the running worst cost, and admitted: whether cap (all that was ever paid) and
    run_cap (what this run paid) still hold with it. What one can't have, none behind it gets."""
    rows = running(waiting, ["key"], {"reserved": "worst"})
    rows = rows.crossJoin(F.broadcast(spent(paid).withColumnRenamed("spent", "_all")))
    ok = F.col("_all") + F.col("reserved") <= cap
    if run_cap is not None:
        rows = rows.crossJoin(F.broadcast(spent(run_paid if run_paid is not None else paid.limit(0)).withColumnRenamed("spent", "_run")))
        ok = ok & (F.col("_run") + F.col("reserved") <= run_cap)
    return rows.withColumn("admitted", ok).drop("_all", "_run")


def settled(attempts: DataFrame, fresh: DataFrame) -> DataFrame:
    """attempts and those of fresh whose (key, attempt) they lack, each once."""
    new = fresh.dropDuplicates(["key", "attempt"]).join(attempts.select("key", "attempt"), ["key", "attempt"], "left_anti")
    return attempts.unionByName(new.select(*attempts.columns))


def run(calls: DataFrame, attempts: DataFrame, send: Callable[[DataFrame], DataFrame], cap: float, run_cap: float | None = None) -> tuple[DataFrame, bool]:
    """(all attempts, whether the budget stopped the run).

    calls: key, worst, ...; attempts: key, attempt, ok, cost, ...; send: the admitted calls to their attempts. In every round
    what is pending is admitted, sent and settled, until nothing is pending or the budget admits nothing more. The rounds are
    few: a round leaves out only what its own reserved cost displaced.
    """
    ledger, own = attempts, attempts.limit(0)
    while True:
        waiting = written(pending(calls, ledger), "pending-calls")
        if waiting.isEmpty():
            return ledger, False
        go = written(admitted(waiting, ledger, cap, run_cap, own).where("admitted").drop("admitted", "reserved"), "admitted-calls")
        if go.isEmpty():
            return ledger, True
        fresh = written(send(go), "sent-calls")
        own, ledger = written(settled(own, fresh), "run-attempts"), written(settled(ledger, fresh), "attempts")


# ---- what segments got


def dense(scores: Column, labels: list[str]) -> Column:
    """A map of labels to scores as an array in the labels' order, 0 where it lacks one."""
    return F.transform(F.array(*map(F.lit, labels)), lambda x: F.coalesce(F.try_element_at(scores, x), F.lit(0.0)))


def call_frame(targets: DataFrame, attempts: DataFrame, scores: DataFrame, labels: list[str], thresholds: dict[str, float]) -> DataFrame:
    """One row per target: segment_id, call, cost and latency (its equal share of the call's), call_latency, parse_failure,
    proba (dense), pred_labels.

    targets: call, segment_id; attempts: call, attempt, cost, latency_ms; scores: call, segment_id, label, score of answers that
    parsed, with a null label for a segment that has none. A call's cost is that of all its attempts, its latency that of the
    last. A segment without a row in scores failed to parse; its vector is all 0.
    """
    paid = attempts.groupBy("call").agg(F.sum("cost").alias("cost"), F.max_by("latency_ms", "attempt").alias("call_latency"))
    size = targets.groupBy("call").agg(F.count("*").alias("n"))
    told = scores.groupBy("call", "segment_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "score")))).alias("scores"))
    rows = targets.join(size, "call").join(paid, "call", "left").join(told, ["call", "segment_id"], "left")
    proba = dense(F.coalesce("scores", F.create_map().cast("map<string,double>")), labels)
    cut = F.array(*(F.struct(F.lit(x).alias("label"), F.lit(float(thresholds.get(x, 0.5))).alias("cut")) for x in labels))
    rows = rows.select("segment_id", "call", (F.col("cost") / F.col("n")).alias("cost"), (F.col("call_latency") / F.col("n")).alias("latency"), "call_latency", F.col("scores").isNull().alias("parse_failure"), proba.alias("proba"))
    flags = F.transform(F.filter(F.arrays_zip(F.col("proba").alias("p"), cut.alias("c")), lambda x: x["p"] >= x["c"]["cut"]), lambda x: x["c"]["label"])
    return rows.withColumn("pred_labels", flags)
