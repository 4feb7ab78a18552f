"""A manifest of a table as hash trees: one tree per group, one over the groups, proofs for every row.

Each level is a self-join of the level's nodes by computed sibling numbers: the sibling of slot ``d``
names slot zero of its run (by XOR in a binary tree, by its slot's offset in wider ones), and the
slot-zero rows, which then hold their whole run, emit the parents. Proofs go the other way, from the
root down, so that only whole runs and never single leaves carry the long upper part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litvec.operators.ids import dense_ids
from litvec.runtime import small_side, stage

FAN_OUT = 8
STEP = "struct<before:string,after:string>"


def digest(*parts: Column | str) -> Column:
    """SHA-256 in lowercase hex of the parts one after the other, a null as ``-``, others as length in bytes, ``:`` and value."""
    texts = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    told = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*told), 256)


@dataclass
class Manifest:
    """``leaves``: group, node and leaf with the columns carried along; ``groups``: group, its name, its number
    of leaves, subroot and path to the root; ``levels``: the runs of every level, leaves first; ``root``: None
    for an empty table. All are tables in the shared folder, the root is one digest.
    """

    leaves: DataFrame
    groups: DataFrame
    levels: list[DataFrame]
    root: str | None
    fan_out: int


def _runs(nodes: DataFrame, fan_out: int, name: str) -> DataFrame:
    """Runs of the nodes ``grp, n, node, hash``: ``grp, n, node`` of slot zero and ``h0, h1, ...``.

    Both sides of every join are dealt by group and slot-zero number, so each node is shuffled once a level.
    """

    def slot_zero(slot: int) -> Column:
        return F.col("node").bitwiseXOR(F.lit(slot).cast("long")) if fan_out == 2 else F.col("node") - slot

    def in_slot(slot: int) -> DataFrame:
        return nodes.where((F.col("n") > 1) & (F.col("node") % fan_out == slot))

    runs = in_slot(0).select("grp", "n", "node", F.col("hash").alias("h0"))
    for slot in range(1, fan_out):
        siblings = in_slot(slot).select("grp", slot_zero(slot).alias("node"), F.col("hash").alias(f"h{slot}"))
        runs = runs.join(siblings, ["grp", "node"], "left")
    return stage(runs, name)


def _parents(runs: DataFrame, fan_out: int) -> DataFrame:
    return runs.select(
        "grp",
        F.ceil(F.col("n") / fan_out).alias("n"),
        F.floor(F.col("node") / fan_out).alias("node"),
        F.sha2(F.concat_ws("", *[f"h{i}" for i in range(fan_out)]), 256).alias("hash"),
    )


def _climb(nodes: DataFrame, most: int, fan_out: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels of runs over nodes ``grp, n, node, hash`` and the last node of every group, ``grp, hash``.

    ``most`` is the size of the largest group; a group of one node is its own last node.
    """
    levels, last = [], nodes.where("n = 1").select("grp", "hash")
    while most > 1:
        levels.append(_runs(nodes, fan_out, f"{name}-{len(levels)}"))
        nodes = _parents(levels[-1], fan_out)
        last = last.union(nodes.where("n = 1").select("grp", "hash"))
        most = -(-most // fan_out)
    return levels, last


def _step(slot: Column, fan_out: int) -> Column:
    """What the run's digests to the left and to the right of a slot are."""

    def side(inside) -> Column:
        return F.concat_ws("", *[F.when(inside(F.lit(i)), F.col(f"h{i}")) for i in range(fan_out)])

    return F.struct(side(lambda i: i < slot).alias("before"), side(lambda i: i > slot).alias("after"))


def _with_upper(runs: DataFrame, upper: DataFrame | None, fan_out: int) -> DataFrame:
    """Runs with ``path``: the steps from their parent up, none where the parent is the last node of its group."""
    none = F.array().cast(f"array<{STEP}>")
    if upper is None:
        return runs.withColumn("path", none)
    above = upper.select("grp", (F.col("node") * fan_out).alias("node"), F.col("path").alias("above"))
    return runs.join(above, ["grp", "node"], "left").withColumn("path", F.coalesce("above", none)).drop("above")


def _paths(levels: list[DataFrame], fan_out: int) -> DataFrame | None:
    """Runs of the lowest level with the steps above them; None where no group has more than one node."""
    upper = None
    for at in reversed(range(len(levels))):
        runs = _with_upper(levels[at], upper, fan_out)
        if at == 0:
            return runs
        slots = F.explode(F.sequence(F.lit(0), F.lit(fan_out - 1))).alias("slot")
        nodes = runs.select("*", slots).select(
            "grp",
            (F.col("node") + F.col("slot")).alias("node"),
            F.concat(F.array(_step(F.col("slot"), fan_out)), "path").alias("path"),
        )
        # Slots behind the end of the last run have no node below them; the join leaves them out.
        upper = stage(nodes, f"paths-{at}")
    return None


def build(
    df: DataFrame, leaf: Column, group: str, order: Sequence[str], carried: Sequence[str | Column] = (), fan_out: int = FAN_OUT
) -> Manifest:
    """Trees over the rows of ``df``: one per value of ``group``, null being one, and one over their roots.

    ``leaf`` is the digest of a row. In a group the leaves ascend by ``order``, nulls first, rows that
    tie by their digest; the groups ascend by their value, null first, text by its bytes. While several
    nodes remain, every ``fan_out`` of them become the SHA-256 of their hex digests, the last ones
    being fewer; a lone node remains as it is. Rows are numbered by a range sort of the whole key, so a
    group that holds all rows is sorted by all tasks. Rows that repeat an id are leaves of their own. Texts
    are read once and not moved; ``carried`` names what travels with a leaf, names of other columns
    do not matter. An empty table has no root.
    """
    keys = [F.col(c).alias(f"key{i}") for i, c in enumerate(order)]
    hashed = df.select(F.col(group).alias("name"), *keys, leaf.alias("hash"), F.struct(F.lit(0).alias("_"), *carried).alias("carried"))
    by = ["name", *[f"key{i}" for i in range(len(keys))], "hash"]
    numbered = stage(dense_ids(stage(hashed, "leaves"), *by, name="id").select("id", "name", "hash", "carried"), "leaves")
    counted = numbered.groupBy("name").agg(F.min("id").alias("first"), F.count("*").alias("size"))
    groups = small_side(dense_ids(stage(counted, "groups"), "name", name="grp"), "groups")
    of_group = F.col("name").eqNullSafe(F.col("own"))
    leaves = numbered.join(groups.withColumnRenamed("name", "own"), of_group).select(
        "grp", F.col("size").alias("n"), (F.col("id") - F.col("first")).alias("node"), "hash", "carried"
    )
    leaves = stage(leaves, "leaves")
    told = groups.agg(F.max("size").alias("most"), F.count("*").alias("many")).first()
    if not told["many"]:
        nothing = groups.select("grp", "name", "size", F.lit("").alias("subroot"), F.array().cast(f"array<{STEP}>").alias("path"))
        return Manifest(leaves, nothing, [], None, fan_out)
    levels, last = _climb(leaves.drop("carried"), told["most"], fan_out, "runs")
    subroots = stage(last, "subroots")
    zero = F.lit(0).cast("long").alias("grp")
    tops = subroots.select(zero, F.lit(told["many"]).cast("long").alias("n"), F.col("grp").alias("node"), "hash")
    upper_levels, root = _climb(tops, told["many"], fan_out, "top-runs")
    upper = _paths(upper_levels, fan_out)
    paths = subroots.select("grp", F.col("hash").alias("subroot"), F.array().cast(f"array<{STEP}>").alias("path"))
    if upper is not None:
        paths = _on_runs(subroots.withColumnRenamed("grp", "node").withColumn("grp", zero), upper, fan_out).select(
            F.col("node").alias("grp"), F.col("hash").alias("subroot"), "path"
        )
    whole = small_side(groups.select("grp", "name", "size").join(paths, "grp"), "groups")
    return Manifest(leaves, whole, levels, root.first()["hash"], fan_out)


def _on_runs(nodes: DataFrame, runs: DataFrame, fan_out: int) -> DataFrame:
    """Nodes ``grp, node, ...`` with the ``path`` from their own run up; an empty one without a run."""
    slot = F.col("node") % fan_out
    dealt = nodes.withColumns({"run": F.col("node") - slot, "slot": slot})
    held = runs.select("grp", F.col("node").alias("run"), *[f"h{i}" for i in range(fan_out)], F.col("path").alias("above"))
    path = F.when(F.col("above").isNotNull(), F.concat(F.array(_step(F.col("slot"), fan_out)), "above"))
    none = F.array().cast(f"array<{STEP}>")
    return dealt.join(held, ["grp", "run"], "left").select(*nodes.columns, F.coalesce(path, none).alias("path"))


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf with its proof: ``carried.*, leaf, subroot, root, path``.

    ``path`` holds, from the leaf up, the joined hex digests before and after the node in its run. The
    long upper parts meet the runs, an eighth as many as leaves, and are spread over the leaves last.
    """
    leaves = manifest.leaves.select("grp", "node", "hash", "carried")
    lowest = _paths(manifest.levels, manifest.fan_out)
    if lowest is None:
        found = leaves.withColumn("path", F.array().cast(f"array<{STEP}>"))
    else:
        found = _on_runs(leaves, lowest, manifest.fan_out)
    tops = manifest.groups.select("grp", "subroot", F.col("path").alias("top"))
    carried = F.col("carried").dropFields("_") if len(manifest.leaves.schema["carried"].dataType) > 1 else None
    return found.join(tops, "grp").select(
        *([] if carried is None else [carried.alias("carried")]),
        F.col("hash").alias("leaf"),
        "subroot",
        F.lit(manifest.root).cast("string").alias("root"),
        F.concat("path", "top").alias("path"),
    )


def proof_digest(path: Column | str = "path") -> Column:
    """SHA-256 of all siblings of a proof, level by level, left to right."""
    path = F.col(path) if isinstance(path, str) else path
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column | str, path: Column | str = "path") -> Column:
    """The root that follows from a leaf and its proof."""
    leaf, path = (F.col(c) if isinstance(c, str) else c for c in (leaf, path))
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))
