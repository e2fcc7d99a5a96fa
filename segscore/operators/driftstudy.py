"""A drift study in full: a null of leave-batch-out batches, thresholds that hold its rate with ties, and alarm rates of
other sets with intervals from a bootstrap in two levels.

Everything a statistic needs is a sum over contracts, so a batch, its reference and a resample are weights over contracts:
rows (batch, key, w). Vectors enter as products of contracts with each other only (a Gram matrix made in blocks).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import draw
from .drift import EPS
from .intervals import edge_index
from .metrics import n_if, ratio

INPUT = ("oov_rate_diff", "tfidf_centroid_distance", "length_psi")
MODEL = ("label_mix_js", "none_share_diff", "confidence_psi")
#: The inner edges of confidence bins; tenths fall into the middle of a bin.
CONFIDENCE_EDGES = [round(0.05 + i / 10, 2) for i in range(10)]
#: Rows that a block of terms has at most, on an average.
TILE_ROWS = 1 << 18


def statistics(models: list[str]) -> list[str]:
    return [*INPUT, *(f"{m}:{s}" for m in models for s in MODEL)]


def families(models: list[str]) -> dict[str, list[str]]:
    return {"input": list(INPUT), **{m: [f"{m}:{s}" for s in MODEL] for m in models}}


# ---- sums by contract


def contract_sums(rows: DataFrame, key: str, models: list[str], labels: list[str], edges: str, n_edges: int) -> DataFrame:
    """key and its additive columns: tokens, oov, l0.. (lengths between the column `edges`), and per model <m>_parsed, <m>_none,
    <m>_y0.. (labels), <m>_c0.. (confidences), <m>_failed.

    rows: key, n_chars, n_tokens, n_oov, edges, and per model <m>_failed (boolean) and <m>_<label>, <m>_p_<label>: what it
    said and its probability. A failed row counts as failed and nowhere else.
    """
    bin_ = edge_index(F.col(edges), F.col("n_chars"))
    out = [F.sum("n_tokens").alias("tokens"), F.sum("n_oov").alias("oov"), *(n_if(bin_ == i).alias(f"l{i}") for i in range(n_edges + 1))]
    for m in models:
        parsed = ~F.col(f"{m}_failed")
        flags = [F.col(f"{m}_{x}") for x in labels]
        most = edge_index(CONFIDENCE_EDGES, F.greatest(*(F.col(f"{m}_p_{x}") for x in labels)))
        some = flags[0]
        for f in flags[1:]:
            some = some | f
        out += [n_if(parsed).alias(f"{m}_parsed"), n_if(parsed & ~some).alias(f"{m}_none"), n_if(~parsed).alias(f"{m}_failed")]
        out += [n_if(parsed & f).alias(f"{m}_y{i}") for i, f in enumerate(flags)]
        out += [n_if(parsed & (most == i)).alias(f"{m}_c{i}") for i in range(len(CONFIDENCE_EDGES) + 1)]
    return rows.groupBy(key).agg(*out)


def gram(vectors: DataFrame, key: str, block: int = 512, term_blocks: int = 16) -> DataFrame:
    """a, b, dot for keys a <= b: the products of sparse vectors (key, term, weight), where any term is shared.

    Keys and terms are dealt into blocks; a task multiplies two blocks of keys over one block of terms as matrices, and the
    products are summed up over the blocks of terms. No term's keys meet each other as rows.
    """
    count = vectors.groupBy(key).agg(F.count("*").alias("n")).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("long").alias("_blocks"), F.greatest(F.lit(term_blocks), F.ceil(F.coalesce(F.sum("n"), F.lit(0)) / TILE_ROWS)).cast("long").alias("_terms"))
    blocked = vectors.crossJoin(F.broadcast(count)).select(F.col(key).alias("k"), "term", "weight", F.pmod(F.xxhash64(key), F.col("_blocks")).alias("_kb"), F.pmod(F.xxhash64("term"), F.col("_terms")).alias("_tb"), "_blocks")
    mine = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), lambda o: F.struct(F.least(o, "_kb").alias("_x"), F.greatest(o, "_kb").alias("_y")))
    tiles = blocked.select("k", "term", "weight", "_kb", "_tb", F.explode(mine).alias("_t")).select("k", "term", "weight", "_kb", "_tb", "_t._x", "_t._y")
    kind = vectors.schema[key].dataType.simpleString()

    def product(tile: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(tile["k"].to_numpy(), return_inverse=True)
        terms, term = np.unique(tile["term"].to_numpy(), return_inverse=True)
        dense = np.zeros((len(names), len(terms)))
        np.add.at(dense, (at, term), tile["weight"].to_numpy())
        side = np.zeros(len(names), np.int64)
        side[at] = tile["_kb"].to_numpy()
        dots = dense @ dense.T
        i, j = np.nonzero(dots)
        x, y = tile["_x"].iloc[0], tile["_y"].iloc[0]
        own = (names[i] <= names[j]) & ((x == y) | (side[i] != side[j]))
        return pd.DataFrame({"a": names[i[own]], "b": names[j[own]], "part": dots[i[own], j[own]]})

    parts = tiles.groupBy("_x", "_y", "_tb").applyInPandas(product, f"a {kind}, b {kind}, part double")
    return parts.groupBy("a", "b").agg(F.sum("part").alias("dot"))


# ---- batches


def positions(members: DataFrame, key: str, w: str | None = None, group: str | None = None) -> DataFrame:
    """group, pos, key, n: the multiset in which a key occurs w times, numbered from 0 in every group; n, its size."""
    times = F.explode(F.sequence(F.lit(1), F.col(w).cast("int"))) if w else F.lit(1)
    rows = members.select((F.col(group) if group else F.lit(0)).cast("long").alias("group"), F.col(key).alias("key"), times.alias("copy"))
    order = W.partitionBy("group").orderBy("key", "copy")
    return rows.select("group", (F.row_number().over(order) - 1).cast("long").alias("pos"), "key", F.count("*").over(W.partitionBy("group")).alias("n"))


def batches(places: DataFrame, k: int, n_batches: int, stream: str) -> DataFrame:
    """batch, key, w: per group n_batches batches of k distinct places each; batch is group * n_batches + its number.

    A batch is drawn from the number of places alone (the j-th step takes a place up to the j-th last, or that one where the
    place is taken: every set of k is as likely), so that only k places of it are ever rows.
    """
    sizes = places.groupBy("group").agg(F.max("n").alias("n"))
    each = sizes.select("group", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_batches - 1).cast("long"))).alias("number"))

    def step(taken: Column, j: Column) -> Column:
        t = draw(stream, F.col("group"), F.col("number"), j) % (j + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, t), j).otherwise(t)))

    steps = F.sequence(F.greatest(F.col("n") - k, F.lit(0).cast("long")), F.col("n") - 1)
    taken = F.aggregate(steps, F.array().cast("array<bigint>"), step)
    rows = each.select("group", (F.col("group") * n_batches + F.col("number")).alias("batch"), F.explode(taken).alias("pos"))
    return rows.join(places.select("group", "pos", "key"), ["group", "pos"]).groupBy("batch", "key").agg(F.count("*").alias("w"))


def sums_of(weights: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    """batch and the weighted sums of all columns."""
    columns = [c for c in sums.columns if c != key]
    return weights.join(sums.withColumnRenamed(key, "key"), "key").groupBy("batch").agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in columns))


def squares(weights: DataFrame, products: DataFrame) -> DataFrame:
    """batch, bb: w'Gw."""
    x, y = (weights.select("batch", F.col("key").alias(k), F.col("w").alias(f"w_{k}")) for k in "ab")
    pairs = x.join(y, "batch").where("a <= b")
    twice = F.when(F.col("a") < F.col("b"), 2).otherwise(1)
    return pairs.join(products, ["a", "b"]).groupBy("batch").agg(F.sum(F.col("w_a") * F.col("w_b") * F.col("dot") * twice).alias("bb"))


def with_all(products: DataFrame) -> DataFrame:
    """key, d: the product of a key's vector with the sum of all."""
    other = products.where("a < b").select(F.col("b").alias("key"), "dot")
    return products.select(F.col("a").alias("key"), "dot").unionByName(other).groupBy("key").agg(F.sum("dot").alias("d"))


# ---- statistics


def added(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def psi(b: Column, r: Column, tb: Column, tr: Column, n: int) -> Column:
    """Population stability index of two arrays of n counts and their sums; null where a side is empty."""
    p, q = (lambda x: (x + EPS) / (tb + n * EPS)), (lambda x: (x + EPS) / (tr + n * EPS))
    return F.when((tb > 0) & (tr > 0), added(F.zip_with(b, r, lambda x, y: (p(x) - q(y)) * F.log(p(x) / q(y)))))


def js(b: Column, r: Column, tb: Column, tr: Column) -> Column:
    """Jensen-Shannon distance, base 2; null where a side is empty."""
    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / ((x + y) / 2))).otherwise(0.0)

    both = F.zip_with(b, r, lambda x, y: part(x / tb, y / tr) + part(y / tr, x / tb))
    return F.when((tb > 0) & (tr > 0), F.sqrt(F.greatest(added(both) / 2, F.lit(0.0))))


def batch_statistics(pairs: DataFrame, models: list[str], labels: int, lengths: int) -> DataFrame:
    """batch, stat, v from rows with both sides: b_<column> and r_<column>, and the products bb, br, rr."""
    hists = {"l": lengths} | {f"{m}_{c}": n for m in models for c, n in (("y", labels), ("c", len(CONFIDENCE_EDGES) + 1))}
    arrays = [F.array(*(F.col(f"{s}_{h}{i}").cast("double") for i in range(n))).alias(f"{s}_{h}") for h, n in hists.items() for s in "br"]
    scalars = [c for c in pairs.columns if c in ("batch", "bb", "br", "rr") or c[2:] in ("tokens", "oov", *(f"{m}_{x}" for m in models for x in ("parsed", "none")))]
    rows = pairs.select(*scalars, *arrays)
    rows = rows.select("*", *(added(F.col(f"{s}_{h}")).alias(f"{s}_{h}_n") for h in hists for s in "br"))
    share = lambda s, a, n: ratio(F.col(f"{s}_{a}"), F.col(f"{s}_{n}"))
    sides_of = lambda h: [F.col(f"{s}_{h}{x}") for x in ("", "_n") for s in "br"]
    values = {
        "oov_rate_diff": share("b", "oov", "tokens") - share("r", "oov", "tokens"),
        "tfidf_centroid_distance": 1 - F.try_divide(F.col("br"), F.sqrt(F.col("bb") * F.col("rr"))),
        "length_psi": psi(*sides_of("l"), lengths),
    }
    for m in models:
        values[f"{m}:label_mix_js"] = js(*sides_of(f"{m}_y"))
        values[f"{m}:none_share_diff"] = F.abs(share("b", f"{m}_none", f"{m}_parsed") - share("r", f"{m}_none", f"{m}_parsed"))
        values[f"{m}:confidence_psi"] = psi(*sides_of(f"{m}_c"), hists[f"{m}_c"])
    each = F.array(*(F.struct(F.lit(s).alias("stat"), v.cast("double").alias("v")) for s, v in values.items()))
    return rows.select("batch", F.inline(each))


def sides(batch: DataFrame, reference: DataFrame, less: bool) -> DataFrame:
    """Rows with b_<column> of a batch and r_<column> of the one-row reference (less: what the batch leaves of it)."""
    columns = [c for c in batch.columns if c != "batch"]
    one = batch.select("batch", *(F.col(c).alias(f"b_{c}") for c in columns)).crossJoin(F.broadcast(reference.select(*(F.col(c).alias(f"_{c}") for c in columns))))
    return one.select("batch", *(F.col(f"b_{c}") for c in columns), *((F.col(f"_{c}") - F.col(f"b_{c}") if less else F.col(f"_{c}")).alias(f"r_{c}") for c in columns))


def null_statistics(sums: DataFrame, products: DataFrame, weights: DataFrame, key: str, models: list[str], labels: int, lengths: int) -> DataFrame:
    """batch, stat, v of batches against all that they leave of their own set."""
    total = sums.agg(*(F.sum(c).alias(c) for c in sums.columns if c != key))
    d = with_all(products)
    whole = F.broadcast(d.agg(F.sum("d").alias("dd")))
    dot = weights.join(d, "key").groupBy("batch").agg(F.sum(F.col("w") * F.col("d")).alias("bd"))
    vectors = squares(weights, products).join(dot, "batch").crossJoin(whole).select("batch", "bb", (F.col("bd") - F.col("bb")).alias("br"), (F.col("dd") - 2 * F.col("bd") + F.col("bb")).alias("rr"))
    return batch_statistics(sides(sums_of(weights, sums, key), total, less=True).join(vectors, "batch"), models, labels, lengths)


def set_statistics(sums: DataFrame, products: DataFrame, against: DataFrame, reference: DataFrame, weights: DataFrame, key: str, models: list[str], labels: int, lengths: int) -> DataFrame:
    """batch, stat, v of batches of another set against a whole reference.

    reference: one row, the reference's sums and rr, its vector's square; against: key, d, the product with its vector.
    """
    dot = weights.join(against, "key", "left").groupBy("batch").agg(F.sum(F.col("w") * F.coalesce("d", F.lit(0.0))).alias("br"))
    vectors = squares(weights, products).join(dot, "batch").crossJoin(F.broadcast(reference.select("rr")))
    return batch_statistics(sides(sums_of(weights, sums, key), reference, less=False).join(vectors, "batch"), models, labels, lengths)


# ---- p-values, thresholds, alarms


def p_values(null: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """batch, stat, p: the share of the null's values at or above each, per statistic; null counts as 1.

    Of the null's own members where no other values are given: a member counts itself. Of other values they count as one more
    member. Both are merged into one order per statistic, whose length the numbers of batches set, not the data's size.
    """
    own = values is None
    marks = null.where("v is not null").select("stat", "v", F.lit(1).alias("c"))
    asked = null if own else values
    order = W.partitionBy("stat").orderBy(F.desc("v")).rangeBetween(W.unboundedPreceding, W.currentRow)
    points = asked.where("v is not null").select("stat", "v").distinct().withColumn("c", F.lit(0))
    upto = marks.unionByName(points).groupBy("stat", "v").agg(F.sum("c").alias("c")).withColumn("ge", F.sum("c").over(order)).drop("c")
    n = marks.groupBy("stat").agg(F.count("*").alias("n"))
    rows = asked.join(upto, ["stat", "v"], "left").join(F.broadcast(n), "stat", "left")
    p = F.col("ge") / F.col("n") if own else (1 + F.col("ge")) / (F.coalesce("n", F.lit(0)) + 1)
    return rows.select("batch", "stat", F.when(F.col("v").isNull(), F.lit(1.0)).otherwise(p).alias("p"))


def scores(p: DataFrame, models: list[str]) -> DataFrame:
    """batch, group, score: the least p of a family, and every statistic by itself."""
    of = {s: [s, *(f for f, members in families(models).items() if s in members)] for s in statistics(models)}
    told = F.create_map(*(x for s, g in of.items() for x in (F.lit(s), F.array(*map(F.lit, g)))))
    return p.select("batch", F.explode(F.element_at(told, F.col("stat"))).alias("group"), "p").groupBy("batch", "group").agg(F.min("p").alias("score"))


def thresholds(null_scores: DataFrame, alpha: float) -> DataFrame:
    """group, threshold, null_alarm_rate: the largest attained score whose share at or below it is at most alpha; null and 0
    where none is."""
    counts = null_scores.groupBy("group", "score").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy("group").orderBy("score").rowsBetween(W.unboundedPreceding, 0))
    share = counts.withColumn("share", upto / F.sum("c").over(W.partitionBy("group")))
    ok = F.col("share") <= alpha
    return share.groupBy("group").agg(F.max(F.when(ok, F.col("score"))).alias("threshold"), F.coalesce(F.max(F.when(ok, F.col("share"))), F.lit(0.0)).alias("null_alarm_rate"))


def alarms(null: DataFrame, limits: DataFrame, values: DataFrame, models: list[str]) -> DataFrame:
    """batch, group, alarm."""
    return scores(p_values(null, values), models).join(F.broadcast(limits), "group").select("batch", "group", F.coalesce(F.col("score") <= F.col("threshold"), F.lit(False)).alias("alarm"))


def alarm_rates(found: DataFrame, n_batches: int) -> DataFrame:
    """resample, group, rate: the share of a resample's batches with an alarm."""
    return found.groupBy(F.floor(F.col("batch") / n_batches).alias("resample"), "group").agg(F.avg(F.col("alarm").cast("double")).alias("rate"))


def rate_intervals(rates: DataFrame, levels: dict[str, float]) -> DataFrame:
    """group and <name>_low, <name>_high: percentile intervals over the resamples."""
    return rates.groupBy("group").agg(*(F.percentile("rate", F.lit(q)).alias(f"{name}_{end}") for name, level in levels.items() for end, q in (("low", (1 - level) / 2), ("high", (1 + level) / 2))))
