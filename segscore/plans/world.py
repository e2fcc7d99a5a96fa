"""Synthetic prediction worlds over the driver's tables, and plans that span several operators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..functions.text import segment_documents
from ..operators import curation
from ..operators.curation import counted_terms, idf_weight
from ..sources.scorer import Scorer, probabilities
from ..sources.written import written

LABELS = ["buy", "hot", "pricey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(events: DataFrame) -> DataFrame:
    """Events as segments of contracts (users) of four types, split by draw into val, test and shift."""
    part = draw("split", "user_id") % 3
    return events.select(
        F.col("event_id").alias("segment_id"), F.col("user_id").alias("contract_id"), (F.col("user_id") % 4).alias("ctype"), "value", "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("k"), F.when(part == 0, "val").when(part == 1, "test").otherwise("shift").alias("split"),
    )


def long_form(events: DataFrame, stream: str = "score") -> DataFrame:
    """One row per (segment, label): y by a rule, p by a keyed draw that leans towards y."""
    truth = {"buy": F.col("event_type").isin("purchase", "signup"), "hot": F.coalesce(F.col("k") >= 50, F.lit(False)), "pricey": F.col("value") > 250}
    rows = segments(events).select("segment_id", "contract_id", "ctype", "split", F.explode(F.array(*(F.struct(F.lit(x).alias("label"), truth[x].alias("y")) for x in LABELS))).alias("v")).select("segment_id", "contract_id", "ctype", "split", "v.label", "v.y")
    noise = (draw(stream, "label", "segment_id") % 1000).cast("double") / 1000
    return rows.withColumn("p", F.lit(0.6) * noise + F.lit(0.4) * F.col("y").cast("int"))


def classify_documents(docs: DataFrame, scorer: Scorer, thresholds: dict[str, float], key: str = "doc_id") -> DataFrame:
    """Documents to flagged segments in one lazy plan: segment, score, cut, flags with confidence (best first)."""
    rows = segment_documents(docs, key).withColumn("proba", probabilities(scorer)(F.col("text")))
    zipped = F.arrays_zip(F.array(*map(F.lit, scorer.labels)).alias("label"), F.col("proba").alias("confidence"), F.array(*(F.lit(float(thresholds[x])) for x in scorer.labels)).alias("cut"))
    flags = F.transform(F.filter(zipped, lambda x: x["confidence"] >= x["cut"]), lambda x: F.struct((-x["confidence"]).alias("c"), x["label"].alias("label")))
    return rows.withColumn("flags", F.transform(F.array_sort(flags), lambda f: F.struct(f["label"].alias("label"), (-f["c"]).alias("confidence"))))


def markdown(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One row, `md`: the (small, reported) rows as a markdown table; bars escaped, doubles with four decimals."""
    kinds = dict(rows.dtypes)
    cell = lambda c: F.coalesce(F.format_string("%.4f", F.col(c)) if kinds[c] == "double" else F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    body = rows.select(F.struct(*order, line.alias("line")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}"
    return body.select(F.concat_ws("\n", F.lit(head), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("md"))


MODELS = ["base", "alt"]
#: Up to three tables are broadcast at a time here (two of terms, one of documents' norms), and the driver makes each. With so many
#: rows at most, its old generation held 223 MB over 0.51 GB of documents, with 4 million 478 MB.
beside = partial(curation.beside, held=1 << 19)


def drift_world(spark: SparkSession, sf_dir: str, asked: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, vectors): documents as segments of contracts (a source's documents of one language), for drift studies.

    segments: contract, ctype, split, n_chars, n_tokens, n_oov (against the terms of two and more validation documents), and
    what two models said, by keyed draws that lean upwards on shift; one in fifty rows failed. vectors: contract, term (a
    64-bit hash), weight: the summed unit TF-IDF vectors of its documents; asked: the one split whose contracts need them.

    Texts are cut once; rows of (document, term) stay in place, beside the counts of terms, and what is shuffled are sums by
    document and by contract and term.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("contract"), F.col("lang").alias("ctype"), "text")
    part = draw("drift", "contract") % 3
    docs = docs.withColumn("split", F.when(part == 0, "val").when(part == 1, "test").otherwise("shift"))
    bags = counted_terms(docs, ["doc_id", "contract", "split"], "text")
    df = bags.select("split", F.explode("counts.item").alias("term")).groupBy("term").agg(F.count("*").alias("df"), (F.count_if(F.col("split") == "val") >= 2).alias("known"))
    df = written(df.where("df >= 2"), "terms")
    weight = idf_weight(bags.count())
    each = beside(bags.select("doc_id", F.inline("counts").alias("term", "tf")), df, "term", often="df").select("doc_id", "tf", "known", weight.alias("w"))
    counts = each.groupBy("doc_id").agg(F.sum("tf").alias("n_tokens"), F.sum(F.when(F.col("known"), 0).otherwise(F.col("tf"))).alias("n_oov"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    counts = written(counts, "drift-counts")
    said = []
    for m in MODELS:
        said.append((draw(f"{m} fails", "doc_id") % 50 == 0).alias(f"{m}_failed"))
        for x in LABELS:
            noise = (draw(m, F.lit(x), "doc_id") % 1000).cast("double") / 1000
            said.append((F.lit(0.8) * noise + F.lit(0.2) * (F.col("split") == "shift").cast("int")).alias(f"{m}_p_{x}"))
    rows = docs.select("doc_id", "contract", "ctype", "split", F.length("text").alias("n_chars"), *said)
    rows = rows.select("*", *((F.col(f"{m}_p_{x}") >= 0.6).alias(f"{m}_{x}") for m in MODELS for x in LABELS)).join(counts.drop("norm"), "doc_id", "left").na.fill(0, ["n_tokens", "n_oov"])
    own = beside(bags.where(F.col("split") == asked) if asked else bags, counts.select("doc_id", "norm"), "doc_id")
    met = beside(own.select("contract", "norm", F.inline("counts").alias("term", "tf")), df, "term", often="df").where("df is not null")
    return rows, met.groupBy("contract", "term").agg(F.sum(weight / F.col("norm")).alias("weight"))
