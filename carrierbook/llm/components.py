"""Connected components of a link table, by star contraction on Spark.

Every task first contracts the links that it holds, some million at a time.  Every round then links
each node's larger neighbours to its smallest neighbour, and each node's smaller neighbours to the
smallest (the two "star" steps of Kiveris et al., 2014).  Neighbour lists are never gathered: the
smallest neighbour is an aggregate, joined back on the node.  Rounds are pinned, so a lost executor
costs one round; they end when every node has one smaller neighbour that has none itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierbook.llm.common import map_rows, pin

LINKS_AT_ONCE = 2_000_000  # links that a task contracts at a time


def _smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, and for each the smallest node that the links reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contracted(slices):
    held, size = [], 0

    def flush():
        nodes, low = _smallest(*(np.concatenate(x) for x in zip(*held)))
        return {"u": nodes[nodes > low], "v": low[nodes > low]}

    for rows in slices:
        held.append(tuple(rows.column(k).to_numpy(zero_copy_only=False) for k in ("u", "v")))
        size += rows.num_rows
        if size >= LINKS_AT_ONCE:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v.  One large-star or small-star step, again with u > v."""
    ways = edges.select("u", "v")
    if large:
        ways = ways.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = ways.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    met = ways.join(low, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (met.select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(low.select("u", F.col("m").alias("v"))))
    return out.where("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """True when the edges are stars around the smallest nodes."""
    ends = edges.select(F.col("u").alias("node"), "v").unionByName(
        edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v")))
    # A node with smaller neighbours must have a single one and be nobody's smaller neighbour.
    seen = ends.groupBy("node").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max(F.col("v").isNull()).alias("centre"))
    return seen.where("least is not null and (least < most or centre)").isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.  Pinned."""
    ends = links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u > v")
    edges = pin(map_rows(ends, _contracted, "u long, v long"))
    for _ in range(most_rounds):
        if _settled(edges):
            break
        edges = pin(_star(_star(edges, True), False))
    else:
        raise RuntimeError("components did not settle")
    return pin(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after further links (a, b) between their nodes or new ones.

    Only the components that the links touch are worked on.
    """
    side = lambda k: labels.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}"))
    between = (links.join(side("a"), "a", "left").join(side("b"), "b", "left")
               .select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")))
    parts = components(between)
    moved = labels.join(parts.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left")
    return pin(moved.select("node", F.coalesce("new", "component").alias("component")).unionByName(parts).distinct())
