"""Merkle manifest of a table: a tree of digests a partition of it (a language, say), and one over their roots.

The leaves of a part are sorted by a range partitioning and numbered by the counts of the pieces before
theirs. Each piece of consecutive leaves then grows a mountain range: a stack with a short list of nodes a
level, where a full run of `FANOUT` nodes is carried as one node to the level above. What a piece can't
complete, the nodes on its unaligned edges, is left open; rounds of grouping by the place of the parent,
a level each, merge the open nodes of all pieces, with the short run at a part's end as it is, unpadded.
A proof needs, besides the nodes of its own block of leaves, what lies above the block; that is carried
down from the root by joins on the place of the parent, a row a block.

Digests are lowercase hex SHA-256 of the concatenated inputs, digests among them as hex text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FANOUT, SHIFT = 8, 3
BLOCK_LEVEL = 3  #: leaves of a block: FANOUT ** BLOCK_LEVEL
LEAVES_A_PIECE = 1 << 16
PATH = "array<struct<left:string,right:string>>"
NODE = "part string, n long, level int, idx long, digest string, open boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """A field of a leaf: "-" if null, else the UTF-8 bytes of its text, ":", the text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)).cast("binary"), 256)


def part_key(value: Column) -> Column:
    """A part's name with null as a value of its own that sorts first."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value.cast("string")))


def nodes_at(n: Column, level: int) -> Column:
    """Nodes that a tree of n leaves has on a level."""
    return F.shiftright(n + ((1 << SHIFT * level) - 1), SHIFT * level)


def height(n: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


@dataclass
class Tree:
    """leaves: part, n (leaves of the part), idx and the rows' own columns; nodes: part, n, level, idx, digest of the levels above; tops: part, n, digest, a row a part; most: leaves of the largest part."""

    leaves: DataFrame
    nodes: DataFrame
    tops: DataFrame
    most: int


def indexed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (part, digest and others) with `idx`, their place in their part by `order` (then digest; nulls first), and `n`, sorted in pieces."""
    held = materialize(rows.withColumn("tie", F.monotonically_increasing_id()))
    total = held.count()
    pieces = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // LEAVES_A_PIECE)
    keys = ["part", *order, "digest", "tie"]  # equal rows can be cut anywhere
    placed = materialize(held.repartitionByRange(pieces, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).withColumn("piece", F.shiftright("at", 33)))
    w = Window.partitionBy("part")
    counts = placed.groupBy("part", "piece").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    counts = counts.select("part", "piece", "first", F.sum("rows").over(w).alias("n"), (F.sum("rows").over(w.orderBy("piece")) - F.col("rows")).alias("before"))
    out = placed.join(counts, ["part", "piece"]).withColumn("idx", F.col("before") + F.col("at") - F.col("first"))
    return materialize(out.drop("tie", "at", "piece", "first", "before").sortWithinPartitions("part", "idx"))


def mountains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node records of pieces of consecutive leaves (part, n, idx, digest), in whatever pieces they come; leaves themselves only where they stay open."""
    out: list[tuple] = []
    stack: list[tuple[int, list[str]]] = []  # a level: place of the first node of the pending run, the run
    part, n, expected = None, 0, -1

    def flush() -> None:
        for level, (first, run) in enumerate(stack):
            out.extend((part, n, level, first + i, x, True) for i, x in enumerate(run))
        stack.clear()

    for batch in batches:
        for p, size, idx, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if p != part or idx != expected:
                flush()
                part, n = p, size
            expected, level = idx + 1, 0
            while True:
                if level == len(stack):
                    stack.append((0, []))
                first, run = stack[level]
                if not run and idx % FANOUT:
                    out.append((part, n, level, idx, x, True))  # its run began in another piece
                    break
                if not run:
                    stack[level] = first, run = idx, []
                run.append(x)
                if len(run) < FANOUT:
                    break
                if level:
                    out.extend((part, n, level, first + i, d, False) for i, d in enumerate(run))
                stack[level] = 0, []
                x, idx, level = digest("".join(run)), first // FANOUT, level + 1
        if len(out) >= 1 << 14:
            yield _nodes(out)
            out = []
    flush()
    if out:
        yield _nodes(out)


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in NODE.split(", ")])


def build(rows: DataFrame, order: list[str]) -> Tree:
    """The trees of all parts. rows: part, digest, the columns of `order` and any others."""
    leaves = indexed(rows, order)
    most = leaves.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    grown = materialize(leaves.select("part", "n", "idx", "digest").mapInArrow(mountains, NODE))
    parent = F.shiftright("idx", SHIFT)
    left = [grown.where("open and level = 0")]
    for level in range(height(most)):
        run = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        joined = F.sha2(F.array_join(F.transform(run, lambda x: x["digest"]), "").cast("binary"), 256)
        merged = left[level].where(nodes_at(F.col("n"), level) > 1).groupBy("part", "n", parent.alias("idx")).agg(joined.alias("digest"))
        merged = materialize(merged.select("part", "n", F.lit(level + 1).alias("level"), "idx", "digest", F.lit(True).alias("open")))
        left.append(grown.where(f"open and level = {level + 1}").unionByName(merged))
    nodes, tops = grown.where("not open and level > 0"), None
    for level, open_ in enumerate(left):
        nodes = nodes.unionByName(open_) if level else nodes
        top = open_.where(nodes_at(F.col("n"), level) == 1)
        top = top.where(nodes_at(F.col("n"), level - 1) > 1) if level else top
        tops = top if tops is None else tops.unionByName(top)
    return Tree(leaves, nodes.drop("open"), materialize(tops.select("part", "n", "digest")), most)


def paths(tree: Tree, level: int, above: DataFrame) -> DataFrame:
    """(part, idx, path and the other columns of `above`) of every node of a level: the digests left and right of it and of its ancestors in their runs.

    above: part, n and the path of the part's top. Parts whose top lies below the level have a row with idx 0.
    """
    kept = [c for c in above.columns if c not in ("part", "path")]
    w = Window.partitionBy("part", F.shiftright("idx", SHIFT)).orderBy("idx").rowsBetween
    beside = lambda a, b: F.array_join(F.collect_list("digest").over(w(a, b)), "")
    leaves = tree.leaves.select("part", "n", F.lit(0).alias("level"), "idx", "digest")
    start = lambda h: above.where((nodes_at(F.col("n"), h) == 1) if h == level else (nodes_at(F.col("n"), h) == 1) & (nodes_at(F.col("n"), h - 1) > 1)).withColumn("idx", F.lit(0).cast("long"))
    top = max(level, height(tree.most))
    current = start(top)
    for h in range(top - 1, level - 1, -1):
        nodes = (tree.nodes if h else leaves).where((F.col("level") == h) & (nodes_at(F.col("n"), h) > 1))
        step = F.struct(beside(Window.unboundedPreceding, -1).alias("left"), beside(1, Window.unboundedFollowing).alias("right"))
        steps = nodes.select("part", "idx", F.shiftright("idx", SHIFT).alias("parent"), F.array(step).alias("step"))
        current = steps.join(current.withColumnRenamed("idx", "parent"), ["part", "parent"]).select("part", "idx", F.concat("step", "path").alias("path"), *kept)
        current = current.unionByName(start(h))
    return current


PROOF = "doc_id long, lang string, part_size long, position long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(leaves: pa.Table, above: pa.Table) -> pa.Table:
    """Proofs of a block of leaves. above: the block's nodes (level, idx, digest) and one row with what lies over it (level null)."""
    context = above.filter(pa.compute.is_null(above["level"])).to_pylist()[0]
    leaves = leaves.sort_by("idx")
    first = leaves["idx"][0].as_py()
    inner = min(BLOCK_LEVEL, height(context["n"]))
    rows: list[list[str]] = [leaves["digest"].to_pylist()] + [[] for _ in range(1, inner)]
    for x in sorted((x for x in above.select(["level", "idx", "digest"]).to_pylist() if x["level"] is not None), key=lambda x: (x["level"], x["idx"])):
        if x["level"] < inner:
            rows[x["level"]].append(x["digest"])
    sides = [[("".join(run[i // FANOUT * FANOUT : i]), "".join(run[i + 1 : i // FANOUT * FANOUT + FANOUT])) for i in range(len(run))] for run in rows]
    over = [(s["left"], s["right"]) for s in context["path"]]
    chains: dict[int, tuple[str, list]] = {}
    out = []
    for i, (leaf, claimed) in enumerate(zip(rows[0], leaves["claimed"].to_pylist(), strict=True)):
        if (k := i >> SHIFT) not in chains:
            steps = [sides[h][i >> SHIFT * h] for h in range(1, inner)] + over
            chains[k] = "".join(a + b for a, b in steps), steps
        said, steps = chains[k]
        own = [sides[0][i]] if inner else []
        folded = claimed
        for a, b in own + steps:
            folded = digest(a + folded + b)
        out.append((first + i, leaf, context["subroot"], context["root"], digest("".join(a + b for a, b in own) + said), folded, folded == context["root"]))
    index, *columns = (pa.array(c) for c in zip(*out, strict=True))
    names = [x.split()[0] for x in PROOF.split(", ")]
    size = pa.array([context["n"]] * len(out), pa.int64())
    return pa.table([leaves["doc_id"].cast(pa.int64()), leaves["lang"].cast(pa.string()), size, index, *columns], names=names)


@dataclass
class Manifest:
    """langs: the tree a language; roots: the tree over their roots."""

    langs: Tree
    roots: Tree

    def nodes(self) -> DataFrame:
        """part ("" for null, else "=" and the language), n, level (from 1), idx, digest."""
        return self.langs.nodes


def manifest(docs: DataFrame, fields: list[str], claimed: Column | None = None, part: str = "lang", doc_id: str = "doc_id") -> Manifest:
    """The trees of docs: a leaf a row, in order of doc_id (nulls first, then by digest), a tree a `part` (null is one), one tree over the parts.

    claimed: a column of digests that proofs are to fold instead of the leaves' own. Repeated rows are leaves
    of their own, long texts are hashed whole, other columns play no part, an empty table has no root.
    """
    own = leaf_digest(*map(F.col, fields))
    rows = docs.select(part_key(F.col(part)).alias("part"), F.col(part).cast("string").alias("lang"), F.col(doc_id).cast("long").alias("doc_id"), own.alias("digest"), F.coalesce(claimed if claimed is not None else own, own).alias("claimed"))
    langs = build(rows, ["doc_id"])
    top = langs.tops.select(F.lit("").alias("part"), F.col("part").alias("lang"), "digest")
    return Manifest(langs, build(top, ["lang"]))


def proofs(made: Manifest) -> DataFrame:
    """One row per leaf (PROOF): its part's and the whole root, the digest of its siblings from level to level, the root its claimed digest folds to with them, and whether that is the root."""
    empty = F.array().cast(PATH)
    whole = made.roots.tops.select("part", "n", empty.alias("path"), F.col("digest").alias("root"))
    by_lang = paths(made.roots, 0, whole).select("idx", "path", "root")
    by_lang = made.roots.leaves.select("idx", F.col("lang").alias("part")).join(by_lang, "idx")
    tops = materialize(made.langs.tops.withColumnRenamed("digest", "subroot").join(by_lang, "part").select("part", "n", "path", "subroot", "root"))
    block = F.shiftright("idx", SHIFT * BLOCK_LEVEL)
    over = paths(made.langs, BLOCK_LEVEL, tops).select("part", F.col("idx").alias("block"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("idx"), F.lit(None).cast("string").alias("digest"), "n", "path", "subroot", "root")
    void = [F.lit(None).cast(t).alias(c) for c, t in (("path", PATH), ("subroot", "string"), ("root", "string"))]
    inner = made.langs.nodes.where(F.col("level") < BLOCK_LEVEL).select("part", F.expr(f"idx >> ({SHIFT} * ({BLOCK_LEVEL} - level))").alias("block"), "level", "idx", "digest", "n", *void)
    leaves = made.langs.leaves.withColumn("block", block).groupBy("part", "block")
    return leaves.cogroup(inner.unionByName(over).groupBy("part", "block")).applyInArrow(prove, PROOF)
