"""Checks and refusals: each returns rows of what is wrong; refuse() raises where there are any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import n_if


class Refused(ValueError):
    """A check found violations."""


def refuse(violations: DataFrame, what: str, show: int = 3) -> None:
    """Raises with a few examples where there is a violation; nothing more than these examples is collected."""
    found = violations.limit(show).collect()
    if found:
        raise Refused(f"{what}: {', '.join(str(tuple(r)) for r in found)}")


def counted(checks: dict[str, DataFrame]) -> DataFrame:
    """check, n: how many rows every check finds."""
    return reduce(DataFrame.unionByName, (bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, bad in checks.items()))


def wrong_offsets(spans: DataFrame, texts: DataFrame, key: str, text: str, start: str, end: str, answer: str) -> DataFrame:
    """Spans whose offsets don't give their answer back."""
    cut = F.substring(F.col(text), F.col(start).cast("int") + 1, (F.col(end) - F.col(start)).cast("int"))
    return spans.join(texts.select(key, text), key).where(~cut.eqNullSafe(F.col(answer))).select(key, start, end)


def inconsistent(questions: DataFrame, impossible: str, answers: str) -> DataFrame:
    """Questions called impossible that have answers, and others that have none."""
    return questions.where(F.col(impossible) == (F.col(answers) > 0))


def text_match(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, kind: exact, stripped (equal without white space at the ends), different, or missing on one side."""
    bare = lambda c: F.regexp_replace(F.col(c), r"^\s+|\s+$", "")
    j = left.select(key, a).join(right.select(key, b), key, "full")
    return j.select(key, F.when(F.col(a).isNull() | F.col(b).isNull(), "missing").when(F.col(a) == F.col(b), "exact").when(bare(a) == bare(b), "stripped").otherwise("different").alias("kind"))


def bad_fractions(rows: DataFrame, fraction: str, tolerance: float = 1e-9) -> DataFrame:
    """One row where the fractions don't sum to 1."""
    return rows.agg(F.sum(fraction).alias("total")).where((F.abs(F.col("total") - 1) > tolerance) | F.col("total").isNull())


def pair_audit(a: DataFrame, b: DataFrame, key: list[str], equal: list[str]) -> DataFrame:
    """check, n over two prediction tables: keys of one side only, repeated keys, and every column that must be equal."""
    repeated = lambda d: d.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    j = a.select(*key, F.lit(True).alias("_in_a"), *(F.col(c).alias(f"{c}_a") for c in equal)).join(b.select(*key, F.lit(True).alias("_in_b"), *(F.col(c).alias(f"{c}_b") for c in equal)), key, "full")
    both = F.col("_in_a") & F.col("_in_b")
    kinds = {"only a": F.col("_in_b").isNull(), "only b": F.col("_in_a").isNull()} | {f"{c} differs": both & ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in equal}
    one = j.agg(*(n_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in kinds.items()))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(f"`{k}`").alias("n")) for k in kinds))).alias("x")).select("x.check", "x.n")
    return rows.unionByName(counted({"repeated in a": repeated(a), "repeated in b": repeated(b)}))


def differing(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Groups in which a value that must be one is several; null counts as a value."""
    return rows.groupBy(*by).agg(F.countDistinct(F.coalesce(F.col(value).cast("string"), F.lit("\0null"))).alias("values")).where("values > 1")


def not_covered_once(wanted: DataFrame, given: DataFrame, key: list[str]) -> DataFrame:
    """key, times for every wanted key that is not given exactly once, and given keys that nobody wants (times null)."""
    times = given.groupBy(*key).agg(F.count("*").alias("times"))
    j = wanted.select(*key).distinct().withColumn("_w", F.lit(True)).join(times, key, "full")
    return j.where("_w is null or times is null or times <> 1").select(*key, F.when(F.col("_w"), F.coalesce("times", F.lit(0))).alias("times"))


def parity(rows: DataFrame, keys: list[str], a: str, b: str, cut: float) -> DataFrame:
    """keys, pairs, disagreements, flagged (by either), max_diff, passed: of two scores of the same pairs.

    passed: no disagreement at all, or at most a thousandth of the pairs and a hundredth of the flagged ones.
    """
    x, y = F.col(a) >= cut, F.col(b) >= cut
    agg = [F.count("*").alias("pairs"), n_if(x != y).alias("disagreements"), n_if(x | y).alias("flagged"), F.max(F.abs(F.col(a) - F.col(b))).alias("max_diff")]
    t = rows.groupBy(*keys).agg(*agg) if keys else rows.agg(*agg)
    few = (F.col("disagreements") * 1000 <= F.col("pairs")) & (F.col("disagreements") * 100 <= F.col("flagged"))
    return t.withColumn("passed", (F.col("disagreements") == 0) | few)


def parity_verdict(totals: DataFrame, model: str, failed: DataFrame, exact: list[str]) -> DataFrame:
    """totals (model, pairs, disagreements, flagged, ...) with failed (requests) and passed.

    A model with a failed request doesn't pass; one of `exact` passes without any disagreement only, others with at most a
    thousandth of the pairs and a hundredth of what either side flagged. failed: one row per failed request.
    """
    lost = failed.groupBy(model).agg(F.count("*").alias("failed"))
    few = (F.col("disagreements") * 1000 <= F.col("pairs")) & (F.col("disagreements") * 100 <= F.greatest("flagged", F.lit(1)))
    rows = totals.drop("passed").join(lost, model, "left").na.fill(0, ["failed"])
    return rows.withColumn("passed", (F.col("failed") == 0) & F.when(F.col(model).isin(*exact), F.col("disagreements") == 0).otherwise(few))


#: A label export: the text's hash, a state for every category, and the spans, whose values may be of any type.
EXPORT = "text_sha256 string, checklist map<string,string>, spans array<variant>"
STATES = ("marked", "not present")


def export_violations(exports: DataFrame, texts: DataFrame, key: str, categories: list[str]) -> DataFrame:
    """key, rule, path of every violation in label exports (key, export: JSON); none where an export holds.

    texts: key, text. Rules: json (not an object), text (hash of another text, or none of this key), missing and unknown
    (checklist entries), state, category, type (offsets that aren't whole numbers), range, and disagrees: the checklist says
    marked just where spans of the category exist. An export without spans or checklist has none.
    """
    parsed = exports.select(key, F.from_json("export", EXPORT).alias("e"), F.try_parse_json("export").alias("v")).join(texts.select(key, "text"), key, "left")
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    value = lambda s, path, kind: F.try_variant_get(s, path, kind)
    whole = lambda s, c: F.coalesce(F.schema_of_variant(value(s, f"$.{c}", "variant")) == "BIGINT", F.lit(False))
    span = F.transform(
        F.coalesce("e.spans", F.array().cast("array<variant>")),
        lambda s: F.struct(value(s, "$.category", "string").alias("category"), (whole(s, "start") & whole(s, "end")).alias("whole"), value(s, "$.start", "bigint").alias("start"), value(s, "$.end", "bigint").alias("end")),
    )
    rows = parsed.select(key, is_object.alias("ok"), "text", F.col("e.text_sha256").alias("hash"), F.coalesce("e.checklist", F.create_map().cast("map<string,string>")).alias("c"), span.alias("s"))
    known = F.array(*map(F.lit, categories))
    none = F.array().cast("array<struct<rule:string,path:string>>")

    def one(rule: str, cond: Column, path: Column) -> Column:
        return F.when(cond, F.array(F.struct(F.lit(rule).alias("rule"), path.alias("path")))).otherwise(none)

    def each(rule: str, values: Column, path: str) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(rule).alias("rule"), F.concat(F.lit(path), x).alias("path")))

    def spans_that(rule: str, bad: Column) -> Column:
        at = F.filter(F.transform("s", lambda x, i: F.struct(x.alias("x"), i.cast("string").alias("i"))), lambda y: bad(y["x"]))
        return F.transform(at, lambda y: F.struct(F.lit(rule).alias("rule"), F.concat(F.lit("spans."), y["i"]).alias("path")))

    marked = F.array_distinct(F.transform("s", lambda x: x["category"]))
    said = F.map_keys(F.map_filter("c", lambda k, v: v == STATES[0]))
    outside = lambda x: F.coalesce(x["whole"] & ~((x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.length("text"))), F.lit(False))
    body = F.concat(
        one("text", ~F.coalesce(F.col("hash") == F.sha2(F.encode("text", "UTF-8"), 256), F.lit(False)), F.lit("text_sha256")),
        each("missing", F.array_except(known, F.map_keys("c")), "checklist."),
        each("unknown", F.array_except(F.map_keys("c"), known), "checklist."),
        each("state", F.map_keys(F.map_filter("c", lambda k, v: ~F.coalesce(v.isin(*STATES), F.lit(False)))), "checklist."),
        spans_that("category", lambda x: ~F.coalesce(F.array_contains(known, x["category"]), F.lit(False))),
        spans_that("type", lambda x: ~x["whole"]),
        spans_that("range", outside),
        each("disagrees", F.array_intersect(F.map_keys("c"), F.array_union(F.array_except(said, marked), F.array_except(marked, said))), "checklist."),
    )
    found = F.when(F.col("ok"), body).otherwise(F.array(F.struct(F.lit("json").alias("rule"), F.lit("").alias("path"))))
    return rows.select(key, F.inline(found))


def smoke_violations(calls: DataFrame, least: int, rules: dict[str, Column]) -> DataFrame:
    """check, n of a first batch of calls: too few of them, and the calls that break each rule."""
    one = calls.agg(F.greatest(F.lit(least) - F.count("*"), F.lit(0)).cast("long").alias("missing calls"), *(n_if(F.coalesce(c, F.lit(True))).alias(k) for k, c in rules.items()))
    names = ["missing calls", *rules]
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(f"`{k}`").alias("n")) for k in names))).alias("x")).select("x.check", "x.n")
