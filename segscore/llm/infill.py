"""Fill-in-the-middle arrangement and its inverse. Built-in functions only.

regexp_extract_all makes the array of units (code points). Two cuts, drawn from a hash of the document's id, split it;
slice and array_join build the arrangement, and splitting at the sentinels restores the text. A long text's array holds
whole blocks of units except around the cuts, where the units stand singly, so that its size is a small part of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Control strings around the parts, and the pattern that finds one.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = "<[PSM]>"
#: Units in a block.
BLOCK = 4096


def drawn(key: Column, k: int) -> Column:
    """The k-th number (1 to 4) of a key: 32 bits of the hash of "1:" and the key."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def units(text: Column, width: int) -> Column:
    """The text as runs of `width` code points (the last may be shorter), left to right."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))


def joined(units: Column, start: Column, stop: Column) -> Column:
    return F.array_join(F.slice(units, (start + 1).cast("int"), (stop - start).cast("int")), "")


def arrange(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 90, spm: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row for every row of docs.

    Of 100 documents `rate` are cut, and of these `spm` in 100 have the suffix first. A text with a sentinel in it stays
    plain, so that no sentinel is ever ambiguous; an empty or null text is plain and empty. A null key draws as an empty
    one; equal keys draw alike. Very long texts are cut whole, and parts may be empty. No rows give no rows; further
    columns are ignored.
    """
    rows = pick(docs, doc_id=key, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.length("text").cast("long").alias("n"))
    a, b = (drawn(F.col("doc_id"), k) % (F.col("n") + 1) for k in (1, 2))
    plain = (F.col("n") == 0) | F.col("text").rlike(SENTINEL) | (drawn(F.col("doc_id"), 3) % 100 >= rate)
    form = F.when(plain, "plain").when(drawn(F.col("doc_id"), 4) % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("*", form.alias("form"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    # A plain text needs no units.
    rows = rows.select("*", F.when(F.col("form") != "plain", units(F.col("text"), BLOCK)).alias("blocks"))
    rows = rows.select("*", *(F.floor(F.col(c) / BLOCK).cast("int").alias(f"{c}_block") for c in "ab"))
    single = [units(F.coalesce(F.get("blocks", F.col(f"{c}_block")), F.lit("")), 1) for c in "ab"]
    rows = rows.select("*", single[0].alias("a_units"), F.when(F.col("a_block") == F.col("b_block"), F.array().cast("array<string>")).otherwise(single[1]).alias("b_units"))
    one = F.col("a_block") == F.col("b_block")
    between = F.greatest(F.col("b_block") - F.col("a_block") - 1, F.lit(0))
    cells = F.concat(
        F.slice("blocks", 1, F.col("a_block")),
        F.col("a_units"),
        F.slice("blocks", F.col("a_block") + 2, between),
        F.col("b_units"),
        F.slice("blocks", F.col("b_block") + 2, F.greatest(F.size("blocks") - F.col("b_block") - 1, F.lit(0))),
    )
    # Where the cuts lie in the cells.
    left = F.col("a_block") + F.col("a") % BLOCK
    right = F.col("b") % BLOCK + F.when(one, F.col("a_block")).otherwise(F.col("a_block") + F.size("a_units") + between)
    rows = rows.select("doc_id", "text", "n", "form", "a", "b", cells.alias("cells"), left.alias("left"), right.alias("right"))
    parts = [joined(F.col("cells"), F.lit(0), F.col("left")), joined(F.col("cells"), F.col("left"), F.col("right")), joined(F.col("cells"), F.col("right"), F.size("cells"))]
    rows = rows.select("*", *(p.alias(name) for p, name in zip(parts, ("prefix", "middle", "suffix"), strict=True)))
    prefix, suffix = F.concat(F.lit(PREFIX), F.col("prefix")), F.concat(F.lit(SUFFIX), F.col("suffix"))
    middle = F.concat(F.lit(MIDDLE), F.col("middle"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(prefix, suffix, middle)).otherwise(F.concat(suffix, prefix, middle))
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "n", "form", F.when(cut, F.col("a")).alias("prefix_chars"), F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from an arrangement: the parts between its sentinels, put back in order. A null output stays null."""
    parts = F.split(output, SENTINEL)
    first, second, third = (F.get(parts, i) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, third, second)).otherwise(F.concat(second, third, first))


def digests(arranged: DataFrame) -> DataFrame:
    """arrange()'s rows with the hashes of the output and of the text restored from it."""
    back = arranged.withColumn("restored", restored(F.col("output"), F.col("form")))
    hashes = [F.sha2(F.encode(c, "UTF-8"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)
