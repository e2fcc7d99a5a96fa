"""Sources and sinks: nested corpora, prediction tables, ledgers, response caches, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS = ("data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,is_impossible:boolean,answers:array<struct<text:string,answer_start:bigint>>>>>>>>")
PREDICTIONS = (
    "segment_id string, contract_id bigint, split string, start bigint, end bigint, true_labels array<string>, pred_labels array<struct<label:string,confidence:double>>, proba array<double>, model_name string, model_version string, latency_ms double, cost_usd double, parse_failure boolean, call_latency_ms double"
)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A nested question-answer corpus: one row per document (title, paragraphs)."""
    return spark.read.schema(CORPUS).option("multiLine", True).json(path).select(F.explode("data").alias("d")).select("d.*")


def dense_key(df: DataFrame, by: str, out: str) -> DataFrame:
    """Distinct values numbered from 0 in order, by ranges of them: no task sorts them all."""
    from ..operators.ordered import numbered

    values = numbered(df.select(by, F.lit(0).alias("_s")).distinct(), by, "_s")
    return df.join(values.select(by, F.col("_i").alias(out)), by)


def spans(corpus: DataFrame) -> DataFrame:
    """One row per answer, and one with null offsets per question without answers."""
    q = corpus.select("title", F.posexplode("paragraphs").alias("paragraph_idx", "p")).select("title", "paragraph_idx", F.explode("p.qas").alias("q"))
    a = q.select("title", "paragraph_idx", F.substring_index("q.id", "__", -1).alias("category"), "q.is_impossible", (F.size("q.answers") > 0).alias("has_answer"), F.explode_outer("q.answers").alias("a"))
    return a.select("title", "paragraph_idx", "category", "is_impossible", "has_answer", F.col("a.text").alias("answer_text"), F.col("a.answer_start").alias("answer_start"), (F.col("a.answer_start") + F.length("a.text")).alias("answer_end"))


def contexts(corpus: DataFrame) -> DataFrame:
    return corpus.select("title", F.array_join(F.transform("paragraphs", lambda p: p["context"]), "\n").alias("text"))


def walk(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files below root: path, folder, length, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("folder"), "length", "content")


def fingerprint(files: DataFrame) -> DataFrame:
    """A 12-digit version of a set of files, whatever their order of reading."""
    # Sums of the hashes' parts: no list of all files in one row, and any set of files has one version.
    h = F.sha2("content", 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(5)]
    return files.agg(*parts, F.count("*").cast("string").alias("n")).select(F.substring(F.sha2(F.concat_ws("|", "n", *(f"s{i}" for i in range(5))), 256), 1, 12).alias("version"))


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV files with a header."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def json_rows(df: DataFrame, out: str = "json") -> DataFrame:
    """Every row as one JSON object, nulls left in."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(out))


def settings(env: dict[str, str], lists: dict[str, str], numbers: dict[str, float]) -> dict:
    """Settings from an environment: comma-separated lists and numbers, each with a default where unset or empty."""
    told = {k: [x.strip() for x in (env.get(k) or d).split(",") if x.strip()] for k, d in lists.items()}
    return told | {k: float(env.get(k) or d) for k, d in numbers.items()}


class ResponseCache:
    """Responses by request key, as a table that tasks append to; of several for a key the last by time counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def save(self, records: DataFrame) -> None:
        records.select("key", F.col("at").cast("timestamp").alias("at"), "record").write.mode("append").parquet(self.path)

    def load(self, keys: DataFrame) -> DataFrame:
        """key, record (null for a miss) of the asked keys."""
        held = self.spark.read.schema("key string, at timestamp, record string").parquet(self.path)
        return keys.join(held.groupBy("key").agg(F.max_by("record", "at").alias("record")), "key", "left")


def prediction_frame(rows: DataFrame, labels: list[str], thresholds: dict[str, float], model: str, version: str) -> DataFrame:
    """Adds pred_labels (labels at or above their threshold, with confidence) and the model's constants to `proba` rows."""
    names = F.array(*map(F.lit, labels))
    cut = F.array(*(F.lit(float(thresholds[x])) for x in labels))
    zipped = F.arrays_zip(names.alias("label"), F.col("proba").alias("confidence"), cut.alias("cut"))
    pred = F.transform(F.filter(zipped, lambda x: x["confidence"] >= x["cut"]), lambda x: F.struct(x["label"].alias("label"), x["confidence"].alias("confidence")))
    return rows.withColumns({"pred_labels": pred, "model_name": F.lit(model), "model_version": F.lit(version)})


def conformed(df: DataFrame) -> DataFrame:
    """df in the prediction schema; ValueError where a required column is missing."""
    schema = T.StructType.fromDDL(PREDICTIONS)
    optional = {"parse_failure": F.lit(False), "call_latency_ms": F.lit(None).cast("double")}
    missing = [f.name for f in schema if f.name not in df.columns and f.name not in optional]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*((F.col(f.name) if f.name in df.columns else optional[f.name]).cast(f.dataType).alias(f.name) for f in schema))


def write_predictions(df: DataFrame, path: str, label_order: list[str], notes: dict[str, str] | None = None) -> None:
    """Predictions, partitioned so that a reader prunes by model and split, and a sidecar with what describes them."""
    import json

    conformed(df).write.mode("errorifexists").partitionBy("model_name", "split").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(label_order, json.dumps(notes or {}))], "label_order array<string>, notes string").write.parquet(f"{path}/about")


def read_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], dict]:
    import json

    about = spark.read.parquet(f"{path}/about").first()
    return spark.read.parquet(f"{path}/rows"), list(about["label_order"]), json.loads(about["notes"])


def append_ledger(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def ledger_total(spark: SparkSession, path: str, cost: str = "cost_usd") -> Column | float:
    return spark.read.schema(f"{cost} double").json(path).agg(F.coalesce(F.sum(cost), F.lit(0.0))).first()[0]
