"""Sharding by a tree of weighted hash draws: region, then rack, then shard.

At each level a key draws an exponential of rate `weight` for each child, from a hash of the child's name and the key,
and descends to the least. A child whose weight rises only draws keys to itself, and children whose weights stay never
exchange keys, so movement stays in the subtrees whose weights change. A shard is added as a subtree of its own: keys
then move to it and nowhere else. Everything is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postora.llm.frames import anonymous, celled, cut, free, with_running_total


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. A shard has its number and weight; what is above weighs what its shards weigh."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own: float = 1.0

    @property
    def weight(self) -> float:
        return self.own if self.shard is not None else sum(c.weight for c in self.children)

    def shards(self) -> list[Node]:
        return [self] if self.shard is not None else [s for c in self.children for s in c.shards()]


@dataclass(frozen=True)
class Topology:
    """Regions of racks of shards."""

    regions: tuple[Node, ...] = field(default_factory=tuple)

    @staticmethod
    def even(shards: int, racks: int = 4, regions: int = 2) -> Topology:
        """Shards numbered through racks of as equal a count as may be, racks through regions."""
        leaves = [Node(f"shard{i}", shard=i) for i in range(shards)]
        cutting = lambda items, n: [items[len(items) * i // n : len(items) * (i + 1) // n] for i in range(n)]
        rack_nodes = [Node(f"rack{i}", tuple(part)) for i, part in enumerate(cutting(leaves, min(racks, shards)))]
        return Topology(tuple(Node(f"region{i}", tuple(part)) for i, part in enumerate(cutting(rack_nodes, min(regions, len(rack_nodes))))))

    def grown(self, weight: float = 1.0) -> Topology:
        """With one more shard, in a rack and a region of its own."""
        n = sum(len(r.shards()) for r in self.regions)
        return Topology((*self.regions, Node(f"region+{n}", (Node(f"rack+{n}", (Node(f"shard{n}", shard=n, own=weight),)),))))

    def reweighted(self, shard: int, weight: float) -> Topology:
        def changed(node: Node) -> Node:
            if node.shard is not None:
                return Node(node.name, shard=node.shard, own=weight if node.shard == shard else node.own)
            return Node(node.name, tuple(changed(c) for c in node.children))

        return Topology(tuple(changed(r) for r in self.regions))


def _draw(path: str, child: Node, key: Column) -> Column:
    """An exponential of the child's weight as rate, from 52 bits of a hash of its path and the key."""
    if child.weight <= 0:
        return F.lit(float("inf"))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{path}/{child.name}|"), key)), 1, 13), 16, 10).cast("long")
    return -F.log((bits + 1).cast("double") / float(2**52)) / child.weight


def _drawn(path: str, children: list[Node], key: Column) -> Column:
    """The place of the child with the least draw; equal draws go to the first."""
    if len(children) == 1:
        return F.lit(0)
    return F.array_min(F.array(*[F.struct(_draw(path, c, key).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(children)]))["i"]


def _text_of(key: str) -> Column:
    """A key as it is drawn with; null is a key of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def place(df: DataFrame, key: str, topology: Topology, out: str) -> DataFrame:
    """df with `out`, the shard of its key: it depends on the key and the topology alone. Null is a key."""
    drawn, level = _text_of(key), [("", list(topology.regions))]
    at = free("node", [*df.columns, out])
    df = df.withColumn(at, F.lit(0))
    while True:  # a level of the tree a round: `at` numbers the nodes of the level
        below, column = [], None
        for i, (path, nodes) in enumerate(level):
            chosen = _drawn(path, nodes, drawn) + len(below)
            column = F.when(F.col(at) == i, chosen) if column is None else column.when(F.col(at) == i, chosen)
            below += [(f"{path}/{n.name}", n) for n in nodes]
        df = df.withColumn(at, column)
        if all(n.shard is not None for _, n in below):
            numbers = F.array(*[F.lit(n.shard) for _, n in below])
            return df.withColumn(out, F.element_at(numbers, F.col(at) + 1).cast("int")).drop(at)
        level = [(p, list(n.children)) for p, n in below]


def grown_place(key: str, topology: Topology, shard: Column) -> Column:
    """The shard of a key once `topology.grown()` holds, from its shard before: the new region's draw against the least
    of the others."""
    *before, new = topology.grown().regions
    others = F.least(*[_draw("", r, _text_of(key)) for r in before]) if len(before) > 1 else _draw("", before[0], _text_of(key))
    return F.when(_draw("", new, _text_of(key)) < others, F.lit(new.shards()[0].shard)).otherwise(shard).cast("int")


def assign(docs: DataFrame, topology: Topology, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of docs, with shard_size (UTF-8 bytes and 1), shard_crc32 (of the text's UTF-8, 0 for
    null), shard, shard_slot (from 0 without gaps in each shard, in an order drawn from key and text) and shard_grown,
    the shard once `topology.grown()` holds.

    Null keys are one key, and repeated keys share a shard; slots of equal rows come in any order among them. Null
    texts count no bytes, texts of any length all of theirs. Columns of any name pass through; where docs has a column
    of a result's name, that result has underscores before its own. An empty table gives an empty one.
    """
    outs = ("shard_size", "shard_crc32", "shard", "shard_slot", "shard_grown")
    named = [*docs.columns, *(free(n, docs.columns) for n in outs)]
    docs, names = anonymous(docs)
    key, text, own = names[key], names[text], "shard"
    c = {n: f"shard_{n}" for n in ("size", "crc32", "slot", "grown", "order", "cell")}
    sized = docs.withColumn(c["size"], (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"))
    sized = sized.withColumn(c["crc32"], F.coalesce(F.crc32(F.col(text).cast("string").cast("binary")), F.lit(0)).cast("long"))
    placed = place(sized, key, topology, own)
    placed = placed.withColumn(c["grown"], grown_place(key, topology, F.col(own)))
    placed = placed.withColumn(c["order"], F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col(c["crc32"]).cast("string"))))
    placed = celled(placed, own, c["order"], c["cell"])
    cells = cut(placed.groupBy(c["cell"], own).agg(F.count("*").alias("s")))
    return with_running_total(placed, cells, own, c["cell"], [c["order"], key, c["size"]], F.lit(1), c["slot"]).select(*docs.columns, *outs).toDF(*named)
