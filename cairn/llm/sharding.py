"""Sharding by a hierarchical weighted hash tree, in Spark SQL functions only.

A row descends region, rack and shard. At each node every child draws -ln(u) / weight, u from the md5 of the
key and the child's name, and the least draw wins, so a child is chosen with a chance in proportion to its
weight. A draw depends on the key and the child alone: when a weight changes, the draws of the other children
stay, and rows move only to or from the subtree whose weight changed.

`shard_tree(n)` groups the shards that were planned for; a shard beyond the plan, or in a region that isn't full, stands
as a region of its own, whose weight is new while all others stay. So from the plan on, one more shard takes rows only
into itself, whatever their number; below it that holds but for the shard that fills a region, which regroups it.

Nulls: a null key is a key of its own (the word null); a null text has no bytes. Repeated rows get the same
shard and slots of their own. Other columns take no part and their names don't matter. An empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RACKS_PER_REGION, SHARDS_PER_RACK = 2, 4
#: Shards that regions are planned for.
PLANNED = 24
#: Slots are counted within hash cells of each shard (so many hex digits of md5) and then offset: no task holds a shard.
CELL_DIGITS = 3


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: tuple["Node", ...] = field(default=())
    shard: int = -1


def shard_tree(n_shards: int, racks: int = RACKS_PER_REGION, shards: int = SHARDS_PER_RACK, planned: int = PLANNED) -> Node:
    """Full regions of `racks` racks of `shards` shards for the planned shards, and a region for each other one; a subtree
    weighs the shards that it holds."""
    if n_shards < 1:
        raise ValueError("a tree has one shard at least")
    leaves = [Node(f"shard{i}", 1.0, shard=i) for i in range(n_shards)]
    size = racks * shards
    full = min(n_shards, planned) // size * size
    parts = [leaves[i : i + size] for i in range(0, full, size)] + [[x] for x in leaves[full:]]
    regions = []
    for r, part in enumerate(parts):
        held = [part[i : i + shards] for i in range(0, len(part), shards)]
        regions.append(Node(f"region{r}", float(len(part)), tuple(Node(f"rack{r * racks + k}", float(len(h)), tuple(h)) for k, h in enumerate(held))))
    return Node("root", float(n_shards), tuple(regions))


def unit_draw(key: Column, name: str) -> Column:
    """52 bits of md5 as a number strictly between 0 and 1."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{name}"))), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def descend(key: Column, node: Node) -> Column:
    """The shard below `node` that the key falls to."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    draws = [F.struct((-F.log(unit_draw(key, c.name)) / F.lit(c.weight)).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(node.children)]
    chosen = F.array_min(F.array(*draws))["child"]
    if all(not c.children for c in node.children):
        return F.element_at(F.array(*[F.lit(c.shard) for c in node.children]), chosen + 1)
    # one branch of the CASE runs for a row: draws are made only in the subtree that it is in
    return _branch(chosen, [descend(key, c) for c in node.children])


def _branch(chosen: Column, below: list[Column]) -> Column:
    # transform() holds the choice in a variable, so that it is not computed again for each branch
    def pick(c: Column) -> Column:
        out = F.when(c == 0, below[0])
        for i, x in enumerate(below[1:], 1):
            out = out.when(c == i, x)
        return out

    return F.element_at(F.transform(F.array(chosen), pick), 1)


def assign_shards(df: DataFrame, key: str, tree: Node, out: str = "shard") -> DataFrame:
    """Every row of df and, in column `out`, its shard."""
    return df.withColumn(out, descend(F.coalesce(F.col(key).cast("string"), F.lit("null")), tree).cast("int"))


def with_slots(df: DataFrame, shard: str, order: list[str], out: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, by hash cell, then by `order`; equal rows in any order."""
    whole = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order])
    cells = df.withColumn("_cell", F.substring(F.md5(whole), 1, CELL_DIGITS))
    counts = cells.groupBy(shard, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy(shard, "_cell").orderBy(*order)
    numbered = cells.withColumn("_rank", F.row_number().over(here))
    return numbered.join(offsets, [shard, "_cell"]).withColumn(out, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_cell", "_before", "_rank")


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law (`key`), shard, slot and the shard among n_shards + 1."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(key, shard_tree(n_shards)).cast("int").alias("shard"),
        descend(key, shard_tree(n_shards + 1)).cast("int").alias("grown_shard"),
    )
    return with_slots(rows, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _values(tree: Node, name: str) -> list[str]:
    """The tree's edges as rows of SQL."""
    out = [f"('{name}', '{tree.name}', '{c.name}', CAST({c.weight} AS DOUBLE), {c.shard})" for c in tree.children]
    return out + [x for c in tree.children for x in _values(c, name)]


def oracle(n_shards: int = 24) -> str:
    """shard_documents in SQL; the CRC32 is folded byte by byte over its table."""
    edges = ", ".join(_values(shard_tree(n_shards), "now") + _values(shard_tree(n_shards + 1), "grown"))
    draw = "-ln((CAST('0x' || substr(md5(d.k || ':' || e.name), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE)) / e.weight"
    step = lambda to, of: f"{to} AS (SELECT d.rid, d.k, e.tree, arg_min(e.name, {draw}) AS at, arg_min(e.shard, {draw}) AS shard FROM {of} d JOIN edges e ON e.parent = d.at AND e.tree = d.tree GROUP BY 1, 2, 3)"
    return f"""
WITH edges(tree, parent, name, weight, shard) AS (VALUES {edges}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, COALESCE(CAST(doc_id AS VARCHAR), 'null') AS k, COALESCE(text, '') AS text FROM documents),
start AS (SELECT rid, k, t.tree, 'root' AS at FROM docs, (VALUES ('now'), ('grown')) t(tree)),
{step("a", "start")}, {step("b", "a")}, {step("c", "b")},
tbl AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, n)) AS t),
bytes AS (SELECT rid, list_transform(range(strlen(text)), lambda i: CAST('0x' || substr(hex(encode(text)), 2 * i + 1, 2) AS BIGINT)) AS b FROM docs),
crcs AS (SELECT rid, xor(list_reduce(b, lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM bytes, tbl),
rows AS (SELECT d.doc_id, CAST(strlen(d.text) + 8 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, n.shard, g.shard AS grown_shard
  FROM docs d JOIN crcs USING (rid) JOIN c n ON n.rid = d.rid AND n.tree = 'now' JOIN c g ON g.rid = d.rid AND g.tree = 'grown')
SELECT doc_id, size, text_crc32, 'key' AS law, shard, ROW_NUMBER() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws('|', COALESCE(CAST(doc_id AS VARCHAR), 'null'), text_crc32, size)), 1, {CELL_DIGITS}), doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM rows
"""
