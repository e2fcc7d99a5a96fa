"""A paged search listing, stored as JSON pages: read by Spark's JSON source, one task per run of pages, columns by schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "query string, offset bigint, hits struct<total: struct<value: bigint, relation: string>, hits: array<struct<_id: string, _source: struct<ciks: array<string>, file_date: string, file_type: string, file_description: string, form: string>>>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """query, offset, hits: one row per page. Every file holds one page per line; what a page lacks is null."""
    return spark.read.schema(PAGE).json(path)


def hits(pages: DataFrame) -> DataFrame:
    """accession, file_name, cik, file_type, ...: every hit once, from the first page (by query and offset) that has it.

    A hit's id is accession:file_name; the first of its filers counts, empty where there is none; a null type is empty. Null
    and empty pages give no hits.
    """
    rows = pages.select("query", "offset", F.posexplode("hits.hits").alias("i", "h"))
    one = rows.groupBy(F.col("h._id").alias("id")).agg(F.min_by("h._source", F.struct("query", "offset", "i")).alias("s"))
    return one.select(
        F.split_part("id", F.lit(":"), F.lit(1)).alias("accession"), F.regexp_extract("id", "(?s)^[^:]*:(.*)$", 1).alias("file_name"), F.coalesce(F.get("s.ciks", F.lit(0)), F.lit("")).alias("cik"), F.coalesce("s.file_type", F.lit("")).alias("file_type"),
    )


def report(pages: DataFrame, most: int) -> DataFrame:
    """query, total, relation, truncated, pages, distinct_hits: whether a search told more hits than it gives (over `most`, or
    not as an exact number)."""
    ids = pages.select("query", F.explode("hits.hits").alias("h")).groupBy("query").agg(F.countDistinct("h._id").alias("distinct_hits"))
    told = pages.groupBy("query").agg(F.max_by("hits.total", "offset").alias("t"), F.count("*").alias("pages"))
    rows = told.join(ids, "query", "left")
    return rows.select("query", F.col("t.value").alias("total"), F.col("t.relation").alias("relation"), ((F.col("t.relation") != "eq") | (F.col("t.value") > most)).alias("truncated"), "pages", F.coalesce("distinct_hits", F.lit(0)).alias("distinct_hits"))
