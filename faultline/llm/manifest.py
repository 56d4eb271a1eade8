"""Merkle manifest of a table: a hash tree over each group's rows, one over the groups, a proof for every row.

Rows are numbered inside their group. Blocks of 3 ** depth consecutive nodes ("superblocks") are whole subtrees; each is reduced to one node,
and the nodes of a large group are blocks again, until one is left. Then the proofs come down the same rounds: the rows of a block are cogrouped
with the outer nodes that its own node needs, and one call finishes the reduction inside the block, joins the outer proof to each row's
and folds the row's present leaf up to the root. No group is larger than a block, and a group of any size takes part in blocks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import materialize, ship_package

ARITY = 3
#: A superblock has ARITY ** DEPTH nodes at most.
DEPTH = 7
OWN = "_"


def encoded(columns: Iterable[str | Column]) -> Column:
    """Values one after the other: "-" for a null, else the number of UTF-8 bytes, ":" and the value as text."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def reduced(nodes: Sequence[str], levels: int) -> list[list[str]]:
    """The nodes and the levels above them: ``levels`` of them, or with -1 as many as it takes to one node."""
    rows = [list(nodes)]
    while (len(rows[-1]) > 1) if levels < 0 else (len(rows) <= levels):
        below = rows[-1]
        rows.append([digest("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return rows


def proofs(rows: list[list[str]], outer: str) -> list[str]:
    """For each lowest node its way to the root: levels joined by "/", in each the run's nodes joined by "," with "_" at the own place."""
    above = [outer]
    for level in reversed(rows[:-1]):
        own = []
        for i in range(len(level)):
            run = level[i - i % ARITY : i - i % ARITY + ARITY]
            run[i % ARITY] = OWN
            rest = above[i // ARITY]
            own.append(",".join(run) + "/" + rest if rest else ",".join(run))
        above = own
    return above


def fold(leaf: str, proof: str) -> str:
    """The root that a leaf has by its proof."""
    for level in proof.split("/") if proof else ():
        leaf = digest(level.replace(OWN, leaf).replace(",", ""))
    return leaf


def _node_of_block(block: pd.DataFrame) -> pd.DataFrame:
    nodes = block.sort_values("position")["node"].tolist()
    part, position, size = (block[c].iat[0] for c in ("part", "block", "size"))
    return pd.DataFrame({"part": [part], "position": [position], "size": [size], "node": [reduced(nodes, block["levels"].iat[0])[-1][0]]})


def _inner(nodes: pd.DataFrame, outer: pd.DataFrame) -> tuple[pd.DataFrame, list[str]]:
    nodes = nodes.sort_values("position")
    rows = reduced(nodes["node"].tolist(), nodes["levels"].iat[0])
    return nodes, proofs(rows, outer["proof"].iat[0])


def _outer_of_nodes(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    nodes, ways = _inner(nodes, outer)
    return pd.DataFrame({"part": nodes["part"], "block": nodes["position"], "subroot": outer["subroot"].iat[0], "root": outer["root"].iat[0], "proof": ways})


def _proof_of_leaves(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    nodes, ways = _inner(nodes, outer)
    root = outer["root"].iat[0]
    present = nodes["present"].where(nodes["present"].notna(), nodes["node"])
    folded = [fold(leaf, way) for leaf, way in zip(present, ways)]
    return pd.DataFrame({"id": nodes["id"], "part": nodes["part"], "leaf": nodes["node"], "subroot": outer["subroot"].iat[0], "root": root, "proof": ways, "folded_root": folded, "verified": [f == root for f in folded]})


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``position`` of each row in its part, from 0, and the part's ``size``. Rows are dealt into ranges of the whole order, so that a large
    part is numbered in pieces; a range and a part have one count."""
    ranged = materialize(rows.repartitionByRange("part", *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("part", "_range").agg(F.count(F.lit(1)).alias("_n"))
    line = Window.partitionBy("part").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "_range", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("part")).alias("size"))
    local = F.row_number().over(Window.partitionBy("part", "_range").orderBy(*order)) - 1
    return ranged.withColumn("_row", local).join(counts, ["part", "_range"]).withColumn("position", F.col("_before") + F.col("_row")).drop("_range", "_row", "_before")


def _reduced_rounds(nodes: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """``nodes`` (part, position, size, node) and the nodes of its blocks, round by round, and each part's last node (part, node)."""
    width = ARITY**depth
    ended = F.col("size") <= width
    rounds, tops = [], None
    while True:
        nodes = materialize(nodes.withColumns({"block": F.expr(f"position div {width}"), "levels": F.when(ended, -1).otherwise(depth)}))
        rounds.append(nodes)
        above = materialize(nodes.groupBy("part", "block").applyInPandas(_node_of_block, "part string, position long, size long, node string"))
        done = above.where(ended).select("part", "node")
        tops = done if tops is None else tops.unionByName(done)
        nodes = above.where(~ended).withColumn("size", F.expr(f"(size + {width - 1}) div {width}"))
        if nodes.isEmpty():
            return rounds, tops


def _outer_by_rounds(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """What each block of the lowest round needs: (part, block, subroot, root, proof). ``tops`` has it for each part's last node."""
    outer = None
    for at in range(len(rounds) - 1, -1, -1):
        ending = rounds[at].where((F.col("position") == 0) & (F.col("levels") == -1)).select("part", "block").join(tops, "part")
        outer = materialize(ending if outer is None else outer.unionByName(ending))
        if at:
            down = rounds[at].groupBy("part", "block").cogroup(outer.groupBy("part", "block")).applyInPandas(_outer_of_nodes, "part string, block long, subroot string, root string, proof string")
            outer = down
    return outer


def manifest(rows: DataFrame, id_column: str, group: str, columns: Sequence[str], present: dict[str, Column] | None = None, depth: int = DEPTH) -> DataFrame:
    """One row per row: ``id_column``, ``group``, leaf, subroot (of the group), root, proof, folded_root and verified.

    The leaf is the SHA-256 of ``columns``, encoded. Groups are ordered bytewise, null first; inside a group rows ascend by ``id_column`` (null
    first), then leaf. ``present`` has columns as they are now, by name, where they may differ from what the tree was made of: their leaf is folded up by the
    row's proof, and ``verified`` tells whether that gives the root. The proof holds all it takes: see ``fold``. ``depth``: a block has 3 ** depth nodes at most.

    Nulls in any column have their own code, unlike an empty text. Repeated rows are leaves side by side. A text of any length is hashed
    where it is read; only digests move. A lone row's proof is that of its group, a lone group's is empty. An empty table has no rows.
    Columns that are not named are not read, so their names cannot clash."""
    ship_package(rows.sparkSession)
    now = [(present or {}).get(c, F.col(c)) for c in columns]
    leaf, present_leaf = F.sha2(encoded(columns), 256), F.sha2(encoded(now), 256)
    changed = F.when(leaf != present_leaf, present_leaf) if present else F.lit(None).cast("string")
    # A key without nulls whose order is that of the groups: "-" stands before "=".
    part = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    leaves = rows.select(F.col(id_column).alias("id"), part.alias("part"), leaf.alias("node"), changed.alias("present"))
    low, subroots = _reduced_rounds(_numbered(leaves, ["id", "node"]), depth)
    high, top = _reduced_rounds(_numbered(subroots.select(F.lit("").alias("part"), F.col("part").alias("name"), "node"), ["name"]), depth)
    # The tree over the groups: its one part ends in the root, above which nothing is needed.
    whole = top.select("part", F.col("node").alias("subroot"), F.col("node").alias("root"), F.lit("").alias("proof"))
    of_groups = _outer_by_rounds(high, whole)
    named = high[0].groupBy("part", "block").cogroup(of_groups.groupBy("part", "block")).applyInPandas(_outer_of_groups, "part string, subroot string, root string, proof string")
    outer = _outer_by_rounds(low, materialize(named))
    shape = "id string, part string, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"
    ids = low[0].withColumn("id", F.col("id").cast("string"))  # pandas would make numbers with nulls floats
    found = ids.groupBy("part", "block").cogroup(outer.groupBy("part", "block")).applyInPandas(_proof_of_leaves, shape)
    value = F.when(F.col("part") != "-", F.expr("substring(part, 2)")).cast(rows.schema[group].dataType)
    return found.select(F.col("id").cast(rows.schema[id_column].dataType).alias(id_column), value.alias(group), "leaf", "subroot", "root", "proof", "folded_root", "verified")


def _outer_of_groups(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    nodes, ways = _inner(nodes, outer)
    return pd.DataFrame({"part": nodes["name"], "subroot": nodes["node"], "root": outer["root"].iat[0], "proof": ways})


def proof_digest(proof: Column) -> Column:
    """SHA-256 of the proof's digests, one after the other."""
    return F.sha2(F.translate(proof, f"{OWN},/", ""), 256)
