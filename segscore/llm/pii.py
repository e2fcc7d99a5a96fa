"""Personal data by seed patterns and bootstrapped contexts. Built-in functions only.

Seeds are what the four base patterns match. The words around them are lexical patterns: two words before, the word
before, the words on both sides. Patterns and the identifiers that stand in them (seeds, and candidates of a looser form)
make a graph of distinct pairs, so that copies of a text weigh nothing. A pattern's confidence in a kind is the summed
score of its known identifiers over all identifiers in it; a candidate's score is the noisy-or of its patterns'
confidences. Both are computed in turn, some rounds; candidates of a high score are known from then on, wherever they stand.

Positions come from the lengths of matches and of the pieces between them, summed up per text in a window. Equal texts are
looked at once after the scan; texts themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pick, saved

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that no text makes them try twice: a run is entered at its start only (or where the match
#: before ended), and repetitions keep what they took. Cards of under 14 digits are dropped anyway.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Forms that may be an identifier of the kind, where contexts say so.
LOOSE = {
    "email": r"(?<![^\s<(\[,;:\x22'])[^\s@<>()\[\],;:\x22']++(?:@|\x20?[(\[]at[)\]]\x20?)[^\s@<>()\[\],;:\x22']++",
    "ip": r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?:[:.][0-9A-Fa-f]{1,4}){3,7}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9+])[(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}+(?![0-9])",
}
SLOTS = [(kind, patterns[kind], patterns is BASE) for patterns in (BASE, LOOSE) for kind in KINDS]
#: Characters of a context that are looked at on each side.
AROUND = 60
MENTIONS = "key", "kind", "seed", "start", "end", "value", "patterns"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check."""
    def add(total: Column, i: Column) -> Column:
        x = F.substring(number, F.length(number) + 1 - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """Whether a base match holds: an ip's parts, a card's number, a phone's length. Emails always do."""
    n = F.length(digits(value))
    parts = F.forall(F.split(value, r"\."), lambda x: x.cast("double") <= 255)
    card = n.between(14, 19) & F.when(n.between(14, 19), luhn(digits(value))).otherwise(False)
    return F.when(kind == KINDS.index("ip"), parts).when(kind == KINDS.index("card"), card).when(kind == KINDS.index("phone"), n.between(10, 15)).otherwise(True)


def scanned(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, key, hits: every match of every pattern in a text, with the length before it and the words around it.

    The key is the text's hash, null where nothing matches.
    """
    rows = pick(docs, doc_id=key, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    sought = {"email": F.col("text").rlike("@|[(\\[]at[)\\]]"), "phone": F.lit(True)}
    digit = F.col("text").rlike("[0-9]")
    matches = [F.when(sought.get(kind, digit), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"m{i}") for i, (kind, p, _) in enumerate(SLOTS)]
    rows = rows.select("doc_id", "text", *matches)
    rows = rows.select("*", *(F.when(F.size(f"m{i}") > 0, F.split("text", p)).alias(f"p{i}") for i, (_, p, _) in enumerate(SLOTS)))

    def hits(slot: int) -> Column:
        def hit(value: Column, i: Column) -> Column:
            before, after = F.get(f"p{slot}", i), F.get(f"p{slot}", i + 1)
            return F.struct(F.lit(slot).alias("slot"), i.alias("i"), F.length(before).cast("long").alias("before"), value.alias("value"), F.substring(before, -AROUND, AROUND).alias("left"), F.substring(after, 1, AROUND).alias("right"))

        return F.transform(f"m{slot}", hit)

    found = F.concat(*(hits(i) for i in range(len(SLOTS))))
    rows = rows.select("doc_id", "text", found.alias("hits"))
    return saved(rows.select("doc_id", F.when(F.size("hits") > 0, F.unhex(F.md5(F.encode("text", "UTF-8")))).alias("key"), "hits"), "pii-scan")


def contexts(left: Column, right: Column) -> Column:
    """The lexical patterns of a place: two words before; the word before; the words on both sides."""
    def words(x: Column) -> Column:
        return F.filter(F.split(F.regexp_replace(F.lower(x), "[0-9]", "0"), r"\s+"), lambda w: w != "")

    two, one = F.slice(F.concat(F.array(F.lit(""), F.lit("")), words(left)), -2, 2), F.get(words(right), F.lit(0))
    a, b = F.get(two, F.lit(0)), F.get(two, F.lit(1))
    both = F.array(F.when((a != "") & (b != ""), F.concat_ws(" ", a, b, F.lit("_"))), F.when(b != "", F.concat_ws(" ", b, F.lit("_"))), F.when((b != "") & one.isNotNull(), F.concat_ws(" ", b, F.lit("_"), one)))
    return F.filter(both, lambda p: p.isNotNull())


def mentions(scan: DataFrame) -> DataFrame:
    """One row per seed and per candidate that no seed overlaps, of every distinct text: MENTIONS."""
    rows = scan.where("key is not null").select("key", F.inline("hits")).distinct()
    length = F.length("value").cast("long")
    upto = F.sum(F.col("before") + length).over(W.partitionBy("key", "slot").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.repartition("key").select("key", (F.col("slot") % len(KINDS)).alias("kind"), (F.col("slot") < len(KINDS)).alias("base"), (upto - length).alias("start"), upto.alias("end"), "value", "left", "right")
    rows = rows.where(~F.col("base") | valid(F.col("kind"), F.col("value"))).withColumnRenamed("base", "seed")
    forward = W.partitionBy("key").orderBy("start", F.desc("seed")).rowsBetween(W.unboundedPreceding, -1)
    backward = W.partitionBy("key").orderBy(F.desc("start"), "seed").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select("*", F.max(F.when(F.col("seed"), F.col("end"))).over(forward).alias("seed_end"), F.min(F.when(F.col("seed"), F.col("start"))).over(backward).alias("seed_start"))
    clear = F.coalesce(F.col("seed_end") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("seed_start") >= F.col("end"), F.lit(True))
    value = F.when(F.col("kind") <= KINDS.index("ip"), F.lower("value")).otherwise(digits(F.col("value")))
    rows = rows.where(F.col("seed") | clear).select("key", "kind", "seed", "start", "end", value.alias("value"), contexts(F.col("left"), F.col("right")).alias("patterns"))
    return saved(rows, "pii-mentions")


def pattern_scores(edges: DataFrame, known: DataFrame) -> DataFrame:
    """pattern, kind, support, confidence from the edges and what is known: kind, value, score."""
    scored = edges.join(known.select("kind", "value", "score"), ["kind", "value"], "left")
    kinds = range(len(KINDS))

    def of(k: int) -> list[Column]:
        mine = F.col("kind") == k
        return [F.sum(F.when(mine, F.col("score"))).alias(f"f{k}"), F.count(F.when(mine, 1)).alias(f"n{k}"), F.count(F.when(mine & F.col("seed"), 1)).alias(f"s{k}")]

    rows = scored.groupBy("pattern").agg(*(c for k in kinds for c in of(k)))
    seeds = sum((F.col(f"s{k}") for k in kinds), F.lit(0))
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(f"f{k}"), F.lit(0.0)).alias("support"), (F.col(f"n{k}") + seeds - F.col(f"s{k}")).alias("n")) for k in kinds))
    rows = rows.select("pattern", F.inline(each))
    return rows.select("pattern", "kind", "support", (F.col("support") / (F.col("n") + 1)).alias("confidence"))


def bootstrap(found: DataFrame, rounds: int, support: float, confidence: float, score: float) -> tuple[DataFrame, DataFrame]:
    """(patterns: pattern, kind, support, confidence), (known: kind, value, score, seed) after the rounds."""
    edges = saved(found.select("kind", "value", "seed", F.explode("patterns").alias("pattern")).groupBy("kind", "value", "pattern").agg(F.max("seed").alias("seed")), "pii-edges")
    seeds = saved(edges.where("seed").select("kind", "value").distinct().select("kind", "value", F.lit(1.0).alias("score"), F.lit(True).alias("seed")), "pii-seeds")
    # A value that is a seed somewhere is known wherever it stands.
    open_edges = saved(edges.where("not seed").join(seeds.select("kind", "value"), ["kind", "value"], "anti"), "pii-open")
    known, patterns, before = seeds, None, ()
    for _ in range(rounds):
        patterns = saved(pattern_scores(edges, known).where((F.col("support") >= support) & (F.col("confidence") >= confidence)), "pii-patterns")
        misses = F.sum(F.log(F.lit(1.0) - F.col("confidence")))
        fresh = open_edges.join(patterns, ["pattern", "kind"]).groupBy("kind", "value").agg((F.lit(1.0) - F.exp(misses)).alias("score")).where(F.col("score") >= score)
        known = saved(seeds.unionByName(fresh.select("kind", "value", "score", F.lit(False).alias("seed"))), "pii-known", before)
        before = (known, patterns)
    return patterns, known


def found_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 3, support: float = 5, confidence: float = 0.7, score: float = 0.9) -> DataFrame:
    """doc_id and spans, array<struct<start, kind, end, seed>> in order: one row for every row of docs.

    start and end count code points, end exclusive; kind is a place in KINDS; seed tells base spans from those that contexts
    found. A pattern counts from `support` known identifiers and `confidence` on, a candidate from `score` on. A candidate
    that a seed overlaps is none. A null or empty text has no spans; equal texts have equal spans; rows of equal or null ids
    have one result each; long texts are scanned whole. No rows give no rows; further columns are ignored.
    """
    scan = scanned(docs, key, text)
    found = mentions(scan)
    _, known = bootstrap(found, rounds, support, confidence, score)
    rows = found.where("seed").unionByName(found.where("not seed").join(known.select("kind", "value"), ["kind", "value"], "semi").select(*MENTIONS))
    one = F.struct("start", "kind", "end", "seed")
    spans = saved(rows.groupBy("key").agg(F.sort_array(F.collect_list(one)).alias("spans")), "pii-spans")
    none = F.array().cast(spans.schema["spans"].dataType)
    # Texts without a match need no partner; a hot text's side of the join may be split.
    joined = scan.where("key is not null").select("doc_id", "key").join(spans, "key", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
    return joined.unionByName(scan.where("key is null").select("doc_id", none.alias("spans")))


def learned(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 3, support: float = 5, confidence: float = 0.7, score: float = 0.9) -> DataFrame:
    """pattern, kind, support, confidence: the patterns of the last round. Cases as in found_spans()."""
    return bootstrap(mentions(scanned(docs, key, text)), rounds, support, confidence, score)[0]


def digests(found: DataFrame) -> DataFrame:
    """found_spans()' rows with counts of base spans, their hash, and all spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["seed"])
    rows = found.select("doc_id", "spans", base.alias("base"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(F.encode(told(F.col("base")), "UTF-8"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda x: ~x["seed"])).cast("long").alias("n_discovered"))
