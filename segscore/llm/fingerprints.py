"""Document fingerprints from closed syncmers. Built-in functions only.

A text is its run of words (longer ones cut every 16 characters), lower case. A k-mer of k = 5 words is chosen where the
least of its inner s-mers (s = 2 words, compared by hash) is the first or the last: the choice looks at the k-mer alone,
so equal passages give equal anchors wherever they stand. A fingerprint is all distinct hashes of the chosen k-mers with
the first place of each, and the likeness of two is the Jaccard likeness of their hashes; it grows with the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pick, saved


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def anchors(text: Column) -> Column:
    """The chosen k-mers in text order: array<struct<at int, hash bigint>>, at: the number of words before."""
    words = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\S{1,16}"), F.lit(0)), lambda w: F.xxhash64(w))

    def of_pairs(s: Column) -> Column:
        n = F.greatest(F.size(s) - 3, F.lit(0))
        windows = F.arrays_zip(*(F.slice(s, i, n).alias(f"s{i}") for i in (1, 2, 3, 4)), F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))).alias("at"))
        closed = F.filter(windows, lambda x: F.least(x["s1"], x["s4"]) <= F.least(x["s2"], x["s3"]))
        return F.transform(closed, lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["s1"], x["s3"], x["s4"]).alias("hash")))

    def of_words(h: Column) -> Column:
        n = F.size(h)
        pairs = F.zip_with(F.slice(h, 1, F.greatest(n - 1, F.lit(0))), F.slice(h, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(h).alias("hash")))
        none = F.filter(whole, lambda x: F.lit(False))
        # Fewer than k words, or no closed k-mer at all: the whole text is the one anchor.
        return F.when(n == 0, none).when(n < 5, whole).otherwise(let(pairs, lambda s: let(of_pairs(s), lambda a: F.when(F.size(a) > 0, a).otherwise(whole))))

    return let(words, of_words)


def fingerprint(text: Column) -> Column:
    """array<struct<hash bigint, at int>>: every distinct anchor at its first place, by hash."""
    by_hash = F.sort_array(F.transform(anchors(text), lambda a: F.struct(a["hash"].alias("hash"), a["at"].alias("at"))))
    return let(by_hash, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["hash"] != x["hash"])))


def told(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.hex(x["hash"])), ",")


def places(a: Column, b: Column) -> Column:
    """The anchors that two fingerprints share, in text order: array<struct<left int, right int>>, the first places in each."""
    def side(fp: Column, k: int) -> Column:
        return F.transform(fp, lambda x: F.struct(x["hash"].alias("hash"), F.lit(k).alias("side"), x["at"].alias("at")))

    def common(s: Column) -> Column:  # a hash of both is at neighbouring places
        pairs = F.transform(s, lambda x, i: F.struct(x["at"].alias("left"), F.when(F.get(s, i + 1)["hash"] == x["hash"], F.get(s, i + 1)["at"]).alias("right")))
        return F.sort_array(F.filter(pairs, lambda p: p["right"].isNotNull()))

    return let(F.sort_array(F.concat(side(a, 0), side(b, 1))), common)


def likeness(a: Column, b: Column, shared: Column) -> Column:
    """0 to 1, from two fingerprints and their places(); two empty ones are alike."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(shared) / (F.size(a) + F.size(b) - F.size(shared)))


def positional_matches(a: Column, b: Column) -> Column:
    """Where the anchors of two texts agree: array<struct<left int, right int>>, first place of each hash in b."""
    def place(x: Column) -> Column:
        at = F.array_position(F.transform(b, lambda y: y["hash"]), x["hash"])
        return F.struct(x["at"].alias("left"), F.when(at > 0, F.get(b, (at - 1).cast("int"))["at"]).alias("right"))

    return F.filter(F.transform(a, place), lambda m: m["right"].isNotNull())


def following(ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds next_id, the next greater key (after the last: the first), without ordering all rows in one task.

    Keys are dealt out by range and written; inside a range the next key is the row behind, and only the first key of
    each range goes through one ordered pass. Keys must be distinct and not null.
    """
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(ids.repartitionByRange(n, key).withColumn("_range", F.spark_partition_id()), "ranges")
    firsts = ranged.groupBy("_range").agg(F.min(key).alias("_first"))
    firsts = firsts.select("_range", F.lead("_first").over(W.orderBy("_range")).alias("_then"))
    start = ranged.agg(F.min(key).alias("_start"))
    behind = F.lead(key).over(W.partitionBy("_range").orderBy(key))
    joined = ranged.withColumn("_behind", behind).join(firsts, "_range").join(F.broadcast(start))  # start is one row
    return joined.withColumn("next_id", F.coalesce("_behind", "_then", "_start")).drop("_range", "_behind", "_then", "_start")


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_places, next_places.

    One row for every row. The places are where its anchors stand in it and in the edited text, or the next document.

    The edited text is the first n - floor(n / 2) code points and the first floor(n / 2) (or all) of the next document.
    A null text is empty. Among rows of one doc_id, the next document is the text of the least hash, and each row is
    edited by its own length. Rows of a null doc_id have no next document: the half is dropped, near_next and next_places are null.
    An empty table gives no rows; further columns are ignored.
    """
    base = pick(docs, doc_id=key, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    numbered = base.where("doc_id is not null")
    after = following(numbered.select("doc_id").distinct()).select(F.col("doc_id").alias("prev_id"), F.col("next_id").alias("doc_id"))
    own = numbered.repartition("doc_id")  # both joins read this one exchange
    one = own.withColumn("_r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where("_r = 1")
    heads = one.join(after, "doc_id").select(F.col("prev_id").alias("doc_id"), F.col("text").alias("next"))
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.coalesce(F.substring("next", F.lit(1), half), F.lit("")))
    alone = base.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("string").alias("next"))
    rows = own.join(heads, "doc_id", "left").select("doc_id", "text", "next").unionByName(alone).select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), fingerprint(F.col("text")).alias("fp"), F.when(F.col("next").isNotNull(), fingerprint(F.col("next"))).alias("next_fp"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fp", fingerprint(F.col("edited")).alias("efp"), "next_fp")
    rows = rows.withColumn("edited_places", places(F.col("fp"), F.col("efp"))).withColumn("next_places", F.when(F.col("next_fp").isNotNull(), places(F.col("fp"), F.col("next_fp"))))
    near_next = F.when(F.col("next_fp").isNotNull(), likeness(F.col("fp"), F.col("next_fp"), F.col("next_places")))
    near_edited = likeness(F.col("fp"), F.col("efp"), F.col("edited_places"))
    return rows.select("doc_id", "n_chars", "edited_sha256", told(F.col("fp")).alias("fingerprint"), told(F.col("efp")).alias("edited_fingerprint"), near_edited.alias("near_edited"), near_next.alias("near_next"), "edited_places", "next_places")
