"""Graphs as edge tables: neighbours, transfer, fixpoints, bounded search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.operators.iterate import fixpoint
from wardlight.session import checkpointed


def graph_neighbors(edges: DataFrame) -> DataFrame:
    """``(node, relation, neighbor)`` for successors and predecessors; rows, so a hub is never one big list.

    Both rows of a distinct edge are distinct, so only the edges are compared.
    """
    row = lambda node, relation, neighbor: F.struct(F.col(node).alias("node"), F.lit(relation).alias("relation"), F.col(neighbor).alias("neighbor"))
    both = F.array(row("src", "successor", "dst"), row("dst", "predecessor", "src"))
    return edges.select("src", "dst").distinct().select(F.explode(both).alias("n")).select("n.*")


def taint_transfer(edges: DataFrame, out_state: DataFrame, gen: DataFrame, kill: DataFrame) -> DataFrame:
    """One round of ``OUT = GEN ∪ (IN − KILL)`` with ``IN`` the union over predecessors; sets are ``(node, loc)`` rows."""
    inn = edges.join(out_state, edges["src"] == out_state["node"]).select(F.col("dst").alias("node"), "loc")
    return inn.join(kill, ["node", "loc"], "left_anti").unionByName(gen.select("node", "loc")).distinct()


def taint_fixpoint(edges: DataFrame, gen: DataFrame, kill: DataFrame) -> DataFrame:
    """Least solution of the transfer equations, new facts only in each round."""
    e = checkpointed(edges.select("src", "dst").distinct())
    k = checkpointed(kill.select("node", "loc").distinct())

    def step(front):
        moved = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node"), "loc").distinct()
        return moved.join(k, ["node", "loc"], "left_anti")

    return fixpoint(gen.select("node", "loc"), step)


def call_reachability(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """``(root, node, depth)``: nodes reached from each root within ``max_depth`` steps, least depth."""
    e = checkpointed(edges.select("src", "dst").distinct())
    seed = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))

    def step(front):
        return front.join(e, front["node"] == e["src"]).select("root", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()

    return fixpoint(seed, step, max_rounds=max_depth, on=["root", "node"])


def crawl_frontier(links: DataFrame, seeds: DataFrame, max_depth: int | None = None, cap: int | None = None) -> DataFrame:
    """``(host, url, depth)``: breadth-first reach over stored links inside each seed's host.

    ``links`` is ``(host, url, target_host, target)``. The search runs until nothing new is found. A caller may stop it at
    ``max_depth``, or keep the first ``cap`` pages per host in the order (depth, url); each round then only expands these.
    """
    inner = checkpointed(links.filter("host = target_host").select("host", "url", "target").distinct())
    order = W.partitionBy("host").orderBy("depth", "url")

    def capped(df):
        return df if cap is None else df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= cap).drop("_r")

    visited = checkpointed(capped(seeds.select("host", "url", F.lit(0).alias("depth")).distinct()))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        front = visited.filter(F.col("depth") == depth - 1)
        if front.isEmpty():
            break
        fresh = front.join(inner, ["host", "url"]).select("host", F.col("target").alias("url")).distinct().join(visited, ["host", "url"], "left_anti")
        visited = checkpointed(capped(visited.unionByName(fresh.withColumn("depth", F.lit(depth)))))
    return visited
