"""Merkle manifest of a dataset: trees of digests per group, coordinate look-up proofs, and verification by folding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import materialize
from tamarack.llm.ranking import ranked

#: Children of a node, levels that one shuffle folds, and the most nodes that are broadcast (about 60 bytes each).
ARITY, SPAN, HELD = 3, 5, 20_000

_POWERS = f"array({', '.join(f'{ARITY**i}L' for i in range(39))})"


def _power(level: str) -> str:
    return f"element_at({_POWERS}, cast({level} as int) + 1)"


def _depth(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves: the least d with ARITY ** d >= n."""
    return F.size(F.filter(F.expr(_POWERS), lambda p: p < n))


def digest_of(fields: list[Column]) -> Column:
    """Lower-case hex SHA-256 of the fields: `-` for null, else the UTF-8 byte count, a colon and the value as text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


@dataclass
class Manifest:
    """leaves: (key, tree, index, n, depth, digest, claim and the kept columns), a row per record.
    nodes: (tree, level, index, depth, digest), the materialised node table of the groups' trees, leaves at level 0.
    trees: (tree, group, n, depth, subroot, and index, levels and siblings of the subroot in the top tree).
    root: the dataset's digest in hex, None for an empty table."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None


def _grow(leaves: DataFrame, deepest: int, tag: str) -> DataFrame:
    """(tree, level, index, depth, digest) of every node from (tree, index, depth, digest) of the leaves.

    A round gathers blocks of ARITY ** SPAN nodes, the most that meet in one place, and folds SPAN levels in them.
    """
    nodes = materialize(leaves.select("tree", F.lit(0).alias("level"), "index", "depth", "digest"), tag)
    above = f"transform(sequence(0, (size(element_at(a, -1)) - 1) div {ARITY}), j -> sha2(array_join(slice(element_at(a, -1), cast(j * {ARITY} + 1 as int), {ARITY}), ''), 256))"
    for base in range(0, deepest, SPAN):
        own = nodes.filter((F.col("level") == base) & (F.col("depth") > base))
        blocks = own.groupBy("tree", F.expr(f"index div {ARITY**SPAN}").alias("block"), "depth").agg(F.array_sort(F.collect_list(F.struct("index", "digest"))).alias("own"))
        steps = f"aggregate(sequence(1, least({SPAN}, depth - {base})), cast(array(transform(own, x -> lower(hex(x.digest)))) as array<array<string>>), (a, s) -> concat(a, array({above})))"
        level = blocks.select("tree", "block", "depth", F.posexplode(F.expr(steps)).alias("step", "row")).filter("step > 0")
        row = level.select("tree", "block", "depth", "step", F.posexplode("row").alias("at", "hex"))
        index = F.expr(f"block * {_power(f'{SPAN} - step')} + at")
        grown = row.select("tree", (F.col("step") + base).alias("level"), index.alias("index"), "depth", F.unhex("hex").alias("digest"))
        nodes = nodes.unionByName(materialize(grown, tag))
    return nodes


def _siblings(leaves: DataFrame, nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, siblings): an array of (level, index, digest) in order, for leaves that have any.

    Every leaf explodes the coordinates that its proof needs, from its index and its tree's size alone, and joins the node
    table. Nodes are asked for by all leaves below their parent, so the upper ones would be hot: levels that have at most
    HELD nodes in all (the number is worked out from the sizes) are broadcast, and below them a node has few askers.
    """
    levels = sizes.select(F.explode(F.sequence(F.lit(0), "depth")).alias("level"), "n").groupBy("level").agg(F.sum(F.expr(f"(n + {_power('level')} - 1) div {_power('level')}")).alias("nodes"))
    total, cut = 0, 0
    for r in sorted(levels.collect(), reverse=True):  # a row a level
        total += r["nodes"]
        if total > HELD:
            cut = r["level"] + 1
            break

    def asked(low: str, high: str) -> DataFrame:
        place, power = f"(index div {_power('l')})", _power("l")
        run = f"sequence({place} - {place} % {ARITY}, least({place} - {place} % {ARITY} + {ARITY - 1}, (n + {power} - 1) div {power} - 1))"
        coordinates = f"flatten(transform(case when {high} > {low} then sequence({low}, {high} - 1) else array() end, l -> transform(filter({run}, i -> i <> {place}), i -> struct(l as level, i as index))))"
        return leaves.select("key", "tree", F.explode(F.expr(coordinates)).alias("c")).select("key", "tree", "c.level", "c.index")

    held = nodes.drop("depth").filter(F.col("level") >= cut)
    found = asked(str(cut), "depth").join(F.broadcast(held), ["tree", "level", "index"])
    if cut:
        low = nodes.drop("depth").filter(F.col("level") < cut)
        found = found.unionByName(asked("0", f"least(depth, {cut})").join(low, ["tree", "level", "index"]))
    return found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("level", "index", "digest"))).alias("siblings"))


def _folded(start: str, index: str, depth: str, siblings: str) -> str:
    """SQL of the digest at the top, in hex, from a leaf's digest (hex), its index and depth, and its siblings in order.

    The node on the path itself is put between its siblings, without a digest: there the digest folded so far goes.
    """
    own = f"transform(case when {depth} > 0 then sequence(0, {depth} - 1) else array() end, l -> struct(l as level, {index} div {_power('l')} as index, cast(null as binary) as digest))"
    up = "case when e.level = a.level then a.at else sha2(a.run, 256) end"
    step = f"named_struct('level', e.level, 'at', {up}, 'run', concat(case when e.level = a.level then a.run else '' end, coalesce(lower(hex(e.digest)), {up})))"
    return f"aggregate(array_sort(concat({own}, {siblings})), named_struct('level', 0, 'at', {start}, 'run', ''), (a, e) -> {step}, a -> case when a.run = '' then a.at else sha2(a.run, 256) end)"


def build(docs: DataFrame, digest: Column, group: str = "source", order: str = "doc_id", claim: Column | None = None) -> Manifest:
    """The manifest of a table: `digest` (hex) of each row is a leaf, leaves of a group are ordered by `order`.

    While a tree has several nodes, every three consecutive ones (the last run may be shorter, even one) become the digest
    of their hex digests; what remains is the group's subroot, a lone leaf itself. The subroots, ordered by group, make a
    tree of the same kind, whose top is the root. Order and group ascend, nulls first, strings by their UTF-8 bytes; rows
    with equal order (repeated rows, null ids) are ordered by their digest. `claim` is another digest of each row, kept to
    be verified (default: the leaf itself). Other columns play no part, whatever their names. An empty table has no root.
    """
    raw = lambda c: F.unhex(c)
    rows = docs.select(F.col(group).alias("group"), F.col(order).alias("id"), raw(digest).alias("digest"), raw(digest if claim is None else claim).alias("claim"))
    rows = ranked(rows, "group", ["id", "digest"], "leaves")
    sizes = rows.groupBy("group").agg(F.max("n").alias("n")).select("group", F.col("n").alias("size"), F.lit(0).alias("all"))
    trees = ranked(sizes, "all", ["group"], "groups").select("group", F.col("size").alias("n"), F.col("index").alias("tree"), F.col("n").alias("trees"))
    trees = materialize(trees.withColumn("depth", _depth(F.col("n"))), "trees")
    known = trees.select(F.col("group").alias("_g"), "tree", "depth")
    leaves = materialize(rows.join(known, rows["group"].eqNullSafe(known["_g"])).drop("_g", "group"), "leaves")
    deepest = trees.agg(F.max("depth")).first()[0] or 0
    nodes = _grow(leaves, deepest, "nodes")
    tops = nodes.filter("level = depth").select("tree", F.col("digest").alias("subroot"))
    trees = materialize(trees.join(tops, "tree"), "trees")
    upper = trees.select(F.col("tree").alias("key"), F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), F.col("trees").alias("n"), F.col("subroot").alias("digest"))
    upper = upper.withColumn("depth", _depth(F.col("n")))
    deepest = upper.agg(F.max("depth")).first()[0] or 0
    top_nodes = _grow(upper, deepest, "top")
    root = top_nodes.filter("level = depth").first()
    paths = _siblings(upper, top_nodes, upper.select("n", "depth").limit(1))
    trees = trees.join(paths.withColumnRenamed("key", "tree"), "tree", "left").withColumn("levels", _depth(F.col("trees")))
    return Manifest(leaves, nodes, materialize(trees.withColumn("siblings", _or_none("siblings")), "trees"), root["digest"].hex() if root else None)


def _or_none(siblings: str) -> Column:
    """Leaves without a sibling have an empty array."""
    return F.coalesce(F.col(siblings), F.expr("cast(array() as array<struct<level: int, index: bigint, digest: binary>>)"))


def prove(manifest: Manifest) -> DataFrame:
    """A row per leaf: id, leaf, claim, subroot, root (hex), place and height in its tree (index, depth) and the tree's in
    the top tree (tree, levels), with the siblings on the way to the subroot and from there to the root: arrays of (level,
    index, digest), level by level and left to right. Nothing else is needed to verify a record."""
    own = _siblings(manifest.leaves, manifest.nodes, manifest.trees.select("n", "depth"))
    trees = manifest.trees.select("tree", "subroot", "levels", F.col("siblings").alias("top_siblings"))
    rows = manifest.leaves.join(own, "key", "left").join(trees, "tree")
    shown = lambda c: F.lower(F.hex(c)).alias({"digest": "leaf"}.get(c, c))
    return rows.select("id", shown("digest"), shown("claim"), shown("subroot"), F.lit(manifest.root).cast("string").alias("root"), "index", "depth", "tree", "levels", _or_none("siblings").alias("siblings"), "top_siblings")


def verify(proofs: DataFrame, claim: str = "claim") -> DataFrame:
    """The proofs with proof_sha256 (of all siblings' hex digests in order), folded_root (from the claimed digest and the
    siblings) and verified: folded_root equals root. A null claim folds to null and isn't verified."""
    hexes = F.expr("array_join(transform(concat(siblings, top_siblings), s -> lower(hex(s.digest))), '')")
    out = proofs.withColumn("proof_sha256", F.sha2(hexes, 256))
    out = out.withColumn("folded_root", F.expr(_folded(_folded(claim, "index", "depth", "siblings"), "tree", "levels", "top_siblings")))
    return out.withColumn("verified", F.col("folded_root").eqNullSafe(F.col("root")) & F.col("root").isNotNull())
