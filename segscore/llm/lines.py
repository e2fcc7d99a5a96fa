"""Cross-site line dedup by distinct-site spread. Built-in functions only.

Lines are compared by a 128-bit hash of the trimmed line. A first aggregation drops the lines of one site. The others get
a HyperLogLog sketch of their sites; partial sketches merge in the aggregation. Where an estimate lies near the
threshold, the sites are counted exactly. A line of at least `sites` sites (a short one: of `short_sites`) is boilerplate:
it stays in the document with the smallest doc_id that has it and goes from all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, saved

#: Relative error of a sketch of 2**12 registers, and how many of it count as near the threshold.
LOG_K, ERROR, NEAR = 12, 1.04 / 64, 5
#: A line without such a character is blank and always stays.
SEEN = r"[^ \t\x0B\f\r]"


def line_hash(line: Column) -> Column:
    return F.unhex(F.md5(F.encode(F.trim(line), "UTF-8")))


def boilerplate(docs: DataFrame, sites: int, short_sites: int, short_chars: int) -> tuple[DataFrame, DataFrame]:
    """(rows of lines seen on more than one site: _key, _id, h, site), (h, first) of each boilerplate line."""
    seen = F.filter(F.split("_text", "\n"), lambda x: x.rlike(SEEN))
    lines = F.array_distinct(F.transform(seen, lambda x: F.struct(line_hash(x).alias("h"), (F.length(F.trim(x)) < short_chars).alias("short"))))
    rows = docs.select("_key", "_id", F.xxhash64(F.coalesce("_site", F.lit(""))).alias("site"), F.inline(lines))
    # Written, so that the join has an exchange of its own on each side and adaptive execution may split a hot line.
    spread = saved(rows.groupBy("h").agg(F.min("site").alias("low"), F.max("site").alias("high")).where("low <> high").select("h"), "many-sites")
    rows = saved(rows.join(spread, "h"), "shared-lines", (spread,))
    sketched = saved(rows.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_K)).alias("estimate"), F.min("_id").alias("first"), F.when(F.max("short"), short_sites).otherwise(sites).alias("bound")), "line-spread")
    room = F.greatest(F.lit(1.0), F.col("bound") * (ERROR * NEAR))
    near = sketched.where(F.abs(F.col("estimate") - F.col("bound")) <= room).select("h", "bound")
    # One row per line and site before lines meet: a hot line is then as many rows as it has sites.
    sites_of = maybe_in(rows, "h", near.select("h")).groupBy("h", "site").agg(F.min("_id").alias("first"))
    exact = sites_of.join(near, "h").groupBy("h", "bound").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    found = sketched.where(F.col("estimate") > F.col("bound") + room).select("h", "first").unionByName(exact.where("n >= bound").select("h", "first"))
    return rows, found


def clean_lines(docs: DataFrame, sites: int = 10, short_sites: int = 15, short_chars: int = 20, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """docs with its text cleaned, and n_lines, n_removed behind its columns.

    A null text stays null (no lines); an empty one stays empty; a document of boilerplate alone becomes empty. Lines
    under `short_chars` characters need `short_sites` sites; blank ones always stay. A null site is a site of its own.
    Rows of a null doc_id are never a line's first document, unless all its documents are; then it stays in all of them.
    Repeated rows are cleaned alike (a line stays in all rows of its first doc_id). An empty table gives an empty table.
    Extra columns are kept.
    """
    extra = [c for c in docs.columns if c != text]
    own = docs.select(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("_key"), F.col(f"`{key}`").alias("_id"), F.col(f"`{site}`").alias("_site"), F.col(f"`{text}`").alias("_text"), F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(extra))).alias("_extra"))
    rows, found = boilerplate(own, sites, short_sites, short_chars)
    # A copy of a shared line is one row here, and a hot line one row of `found`: the large side of this join may be split.
    gone = rows.join(found, "h").where(F.coalesce(F.col("_id") != F.col("first"), F.col("first").isNotNull()))
    gone = gone.groupBy("_key").agg(F.collect_set("h").alias("_gone"))  # as many as a document has lines
    split = F.split("_text", "\n")
    kept = F.filter(split, lambda x: ~F.array_contains("_gone", line_hash(x)))
    joined = own.join(gone, "_key", "left").withColumn("_kept", F.when(F.col("_gone").isNull(), split).otherwise(kept))
    out = {text: F.when(F.col("_text").isNotNull(), F.array_join("_kept", "\n"))}
    out |= {c: F.col(f"_extra.c{i}") for i, c in enumerate(extra)}
    counts = [F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(split) - F.size("_kept"), F.lit(0)).cast("long").alias("n_removed")]
    own_counts = [c for n, c in zip(("n_lines", "n_removed"), counts, strict=True) if n not in docs.columns]
    return joined.select(*(out[c].alias(c) for c in docs.columns), *own_counts)
