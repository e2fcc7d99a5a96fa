"""Sharding by a hierarchical weighted hash tree.

Regions hold racks, racks hold shards. A row descends the tree: at each level it draws -ln(u) / weight for every child,
u a hash of its key, and goes to the child with the least draw, so a child gets rows in proportion to its weight.

Weights grow by steps. Every step of a node has a draw of its own, and the step that wins decides which steps below it
compete. Adding a shard adds one step to its region and to its rack, both leading to that shard alone: a row moves only
when a new step wins, and then it lands in the new shard. Nothing moves between the old ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Step:
    """A weight that competes at one level; children compete only after this step has won. shard is set at the leaves."""

    weight: float
    name: str
    children: list[Step] = field(default_factory=list)
    shard: int | None = None


@dataclass
class HashTree:
    """regions x racks x shards at the start (numbered depth first); grow() adds one shard at a time."""

    regions: int
    racks: int
    shards: int
    weights: dict[int, float] = field(default_factory=dict)
    steps: list[Step] = field(default_factory=list)
    size: int = 0

    def __post_init__(self) -> None:
        number = 0
        for r in range(self.regions):
            racks = []
            for k in range(self.racks):
                leaves = []
                for _ in range(self.shards):
                    leaves.append(Step(self.weights.get(number, 1.0), f"s{number}", shard=number))
                    number += 1
                racks.append(Step(sum(x.weight for x in leaves), f"k{r}.{k}", leaves))
            self.steps.append(Step(sum(x.weight for x in racks), f"r{r}", racks))
        self.size = number

    def grow(self, weight: float = 1.0) -> HashTree:
        """One more shard, in the region and rack that its number falls to; the draws of all older steps stay as they are."""
        n = self.size
        leaf = Step(weight, f"s{n}", shard=n)
        self.steps.append(Step(weight, f"r{n % self.regions}+{n}", [Step(weight, f"k{n % self.racks}+{n}", [leaf])]))
        self.size = n + 1
        return self

    def shard(self, *key: Column) -> Column:
        """The shard of a key, as one expression of built-in functions: per level, the least draw among the children."""
        kids: list[list[Step]] = [self.steps]
        places: dict[int, int] = {}  # of a step's children in kids
        todo = list(self.steps)
        for step in todo:
            if step.shard is None:
                places[id(step)] = len(kids)
                kids.append(step.children)
                todo.extend(step.children)
        child = "named_struct('name', '{}', 'weight', {}D, 'to', {})"
        told = ", ".join("array(" + ", ".join(child.format(s.name, repr(float(s.weight)), s.shard if s.shard is not None else places[id(s)]) for s in steps) + ")" for steps in kids)
        tree = F.expr(f"array({told})")

        def draw(step: Column) -> Column:
            u = (F.shiftrightunsigned(F.xxhash64(step["name"], *key), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
            return F.struct((-F.log(u) / step["weight"]).alias("time"), step["to"].alias("to"))

        at = F.lit(0)
        for _ in range(3):  # region, rack, shard; ties have a chance of 2**-53
            at = F.array_min(F.transform(F.get(tree, at), draw))["to"]
        return at


def gapless(df: DataFrame, group: str, order: list[str], out: str, buckets: int) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps and without bringing a group together.

    Rows fall into buckets by a hash of the first order column; the buckets of a group are counted, their counts summed
    up, and rows numbered inside buckets. Only one row per group and bucket meets in the running sum.
    """
    from pyspark.sql import Window as W

    bucketed = df.withColumn("_b", F.pmod(F.xxhash64(F.lit("slot"), order[0]), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = counts.select(group, "_b", (F.sum("_n").over(W.partitionBy(group).orderBy("_b")) - F.col("_n")).alias("_before"))
    row = F.row_number().over(W.partitionBy(group, "_b").orderBy(*order)) - 1
    return bucketed.withColumn("_i", row).join(before, [group, "_b"]).withColumn(out, (F.col("_before") + F.col("_i")).cast("long")).drop("_b", "_i", "_before")


def shard_documents(docs: DataFrame, tree: HashTree, grown: HashTree, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    A null text counts as empty (size 8, crc32 0); a null key is hashed like any value; repeated rows each get a slot of
    their own in the same shard; an empty table gives no rows; further columns of docs are ignored.
    """
    from .common import pick

    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pick(docs, doc_id=key, _text=text)
    body = F.coalesce("_text", F.lit(""))
    rows = rows.select(
        "doc_id",
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        tree.shard(F.col("doc_id")).alias("shard"),
        grown.shard(F.col("doc_id")).alias("grown_shard"),
    )
    return gapless(rows, "shard", ["doc_id", "size", "text_crc32"], "slot", buckets).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, tree: HashTree, path: str, key: str = "doc_id") -> str:
    """Writes docs into one folder per shard and returns the folders' column; a shard may be many files, written by many tasks.

    The column is `shard`, or, where docs has that name, the first of `shard_`, `shard__`, ... that it has not, so that every
    column of docs is kept. A null key is hashed like any value; equal keys, and so repeated rows, lie in one shard; empty
    and very long texts are written like others; an empty table writes no folder.
    """
    taken, column = {c.lower() for c in docs.columns}, "shard"
    while column in taken:
        column += "_"
    docs.withColumn(column, tree.shard(F.col(f"`{key}`"))).write.partitionBy(column).parquet(path)
    return column
