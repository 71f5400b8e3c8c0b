"""Trees and graphs: traversal by doubled steps, status propagation, rebuilding and flattening."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored


def closure(start: DataFrame, steps: DataFrame) -> DataFrame:
    """All places that steps lead to. start: origin, at; steps: a, b, ord. Gives origin, at, depth and path, the ords on the way.

    Steps are doubled in every round (the paths of 2^k steps join themselves), so a chain of n steps takes log n
    rounds, each a stored table. There is no bound on the depth; a cycle below a start is an error, found when a
    path has more steps than there are places.
    """
    jump = stored(steps.where("a is not null and b is not null").select("a", "b", F.array(F.col("ord").cast("bigint")).alias("more")))
    out = stored(start.select("origin", "at", F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("path")))
    most, size = jump.select("a").union(jump.select("b")).distinct().count(), 1
    while True:
        far = stored(out.join(jump, out["at"] == jump["a"]).select("origin", F.col("b").alias("at"), (F.col("depth") + size).alias("depth"), F.concat("path", "more").alias("path")))
        if far.isEmpty():
            return out
        if size > most:
            raise ValueError("the edges have a cycle")
        out = out.unionByName(far)
        on = jump.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("more").alias("then"))
        jump, size = stored(jump.join(on, "b").select("a", F.col("c").alias("b"), F.concat("more", "then").alias("more"))), 2 * size


def walk(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth, path) of all nodes below each root (column node), however deep; path is the sequence of
    sibling orders, so ordering by it is pre-order. edges: parent, child, ord. A cycle is an error."""
    reached = closure(roots.select(F.col("node").alias("origin"), F.col("node").alias("at")), edges.select(F.col("parent").alias("a"), F.col("child").alias("b"), "ord"))
    return reached.select(F.col("origin").alias("root"), F.col("at").alias("node"), "depth", "path")


def leaves(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("node")).join(edges.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")


def up_to_root(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, at, steps): the chain of ancestors of each start node, itself first, however long. A cycle is an error."""
    reached = closure(start.select(F.col("node").alias("origin"), F.col("node").alias("at")), edges.select(F.col("child").alias("a"), F.col("parent").alias("b"), F.lit(0).alias("ord")))
    return reached.select(F.col("origin").alias("node"), "at", F.col("depth").alias("steps"))


def distance_to_proof(edges: DataFrame, proved: DataFrame) -> DataFrame:
    """(node, distance): for every node with a proved descendant or itself proved, the least number of steps. Least
    distances by doubled steps, one row a node in every round; cycles do no harm."""
    jump = stored(edges.where("parent is not null and child is not null").select("child", "parent").distinct())
    least = stored(proved.select("node", F.lit(0).alias("distance")).distinct())
    most, size = jump.select("child").union(jump.select("parent")).distinct().count(), 1
    while size <= most and not jump.isEmpty():
        far = least.join(jump, least["node"] == jump["child"]).select(F.col("parent").alias("node"), (F.col("distance") + size).alias("distance"))
        least = stored(least.unionByName(far).groupBy("node").agg(F.min("distance").alias("distance")))
        on = jump.select(F.col("child").alias("parent"), F.col("parent").alias("far"))
        jump, size = stored(jump.join(on, "parent").select("child", F.col("far").alias("parent")).distinct()), 2 * size
    return least


def shortest_path(edges: DataFrame, distances: DataFrame, root: str) -> DataFrame:
    """(step, node): from the root always to the child with the least distance, the first by order among equals."""
    best = edges.join(distances.withColumnRenamed("node", "child"), "child").groupBy("parent").agg(F.min_by("child", F.struct("distance", "ord")).alias("child"), F.min("distance").alias("distance"))
    goes = best.join(distances.withColumnRenamed("node", "parent").withColumnRenamed("distance", "own"), "parent").where("distance < own")
    start = edges.sparkSession.createDataFrame([(root, root)], "origin string, at string")
    return closure(start, goes.select(F.col("parent").alias("a"), F.col("child").alias("b"), F.lit(0).alias("ord"))).select(F.col("depth").alias("step"), F.col("at").alias("node"))


def serialise(nodes: DataFrame, edges: DataFrame, tree: str = "tree_id") -> DataFrame:
    """One JSON document a tree: nodes and edges keyed by id."""
    n = nodes.groupBy(tree).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", F.struct(*[c for c in nodes.columns if c not in (tree, "id")]).alias("v"))))).alias("nodes"))
    e = edges.groupBy(tree).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", F.struct(*[c for c in edges.columns if c not in (tree, "id")]).alias("v"))))).alias("edges"))
    return n.join(e, tree, "left").select(tree, F.to_json(F.struct("nodes", "edges")).alias("doc"))


def deserialise(docs: DataFrame, node_type: str, edge_type: str, tree: str = "tree_id") -> tuple[DataFrame, DataFrame]:
    parsed = docs.select(tree, F.from_json("doc", f"nodes map<string,{node_type}>, edges map<string,{edge_type}>").alias("d"))
    nodes = parsed.select(tree, F.explode("d.nodes").alias("id", "v")).select(tree, "id", "v.*")
    return nodes, parsed.select(tree, F.explode("d.edges").alias("id", "v")).select(tree, "id", "v.*")


def state_parents(states: DataFrame) -> DataFrame:
    """Each state with its parent's tactics and depth-one chain."""
    p = states.select(F.col("id").alias("parent_state_id"), F.col("tactics").alias("parent_tactics"))
    return states.join(p, "parent_state_id", "left")


def merge_children(children: DataFrame) -> DataFrame:
    """Children of a node that are equal in goals and validity as one, with the best log-probability."""
    return children.groupBy("parent", "goals", "is_valid").agg(F.max("logprob").alias("logprob"), F.count("*").alias("merged"))


def group_snapshots(steps: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    return steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("steps"))


NODE = "tree_id string, node_id int, parent_id int, text string, synthetic boolean, start_line int, start_column int, end_line int, end_column int, goals_before array<string>, goals_after array<string>"


def flatten_infotree(doc: str | None) -> list[tuple]:
    """Nodes of one info tree in depth-first order: nodes that failed to print are left out with their children
    taken over, and an only child that repeats its parent is folded into it."""
    if not doc:
        return []
    out: list[tuple] = []

    def facts(node):
        stx = node.get("stx") or {}
        r = stx.get("range") or {}
        s, f = r.get("start") or {}, r.get("finish") or {}
        return (stx.get("pp") or "", bool(r.get("synthetic")), s.get("line", 0), s.get("column", 0), f.get("line", 0), f.get("column", 0), node.get("goalsBefore") or [], node.get("goalsAfter") or [])

    pending = [(t, -1) for t in reversed(json.loads(doc))]
    while pending:
        tree, parent = pending.pop()
        mine, kids = facts(tree.get("node") or {}), tree.get("children") or []
        if "failed to pretty print" in mine[0]:
            pending += [(k, parent) for k in reversed(kids)]
            continue
        while len(kids) == 1 and facts(kids[0].get("node") or {}) == mine:
            kids = kids[0].get("children") or []
        out.append((len(out), parent, *mine))
        pending += [(k, out[-1][0]) for k in reversed(kids)]
    return out


def infotree_nodes(trees: DataFrame, tree: str = "tree_id", doc: str = "infotree") -> DataFrame:
    """flatten_infotree over a table, a row for each node; a tree is one task's unit."""
    def run(batches):
        names = [x.split()[0] for x in NODE.split(", ")]
        for pdf in batches:
            yield pd.DataFrame([(t, *n) for t, d in zip(pdf[tree], pdf[doc], strict=True) for n in flatten_infotree(d)], columns=names)

    return trees.select(F.col(tree).cast("string").alias(tree), doc).mapInPandas(run, NODE)


def merge_equal_goals(steps: list[dict]) -> list[dict]:
    """Left to right: a step whose goals don't change takes in its successor, which is then skipped."""
    out, i = [], 0
    while i < len(steps):
        s = dict(steps[i])
        if i + 1 < len(steps) and list(s["goals_before"]) == list(s["goals_after"]):
            n = steps[i + 1]
            s |= {"tactic": s["tactic"] + n["tactic"], "goals_after": n["goals_after"]}
            i += 1
        out.append(s)
        i += 1
    return out


def parse_outline(text: str) -> list[tuple[str, str | None, str, str]]:
    """(id, parent, type, content) of a box-drawing outline: 'Type 1.2: content' lines; the parent is the number
    without its last part; lines without a heading continue the one before; nodes without a parent hang off the first."""
    import re

    out: list[list] = []
    for line in text.splitlines():
        bare = line.lstrip(" │├└─|`-+\t")
        m = re.match(r"([A-Z][A-Za-z ]*?)\s+(\d+(?:\.\d+)*)\s*[:.]\s*(.*)", bare)
        if m:
            out.append([m[2], None, m[1], m[3].strip()])
        elif bare.strip() and out:
            out[-1][3] += "\n" + bare.strip()
    ids = {o[0] for o in out}
    for k, o in enumerate(out):
        up = o[0].rpartition(".")[0]
        o[1] = up if up in ids else (out[0][0] if k else None)
    return [tuple(o) for o in out]


def outline_nodes(df: DataFrame, key: str, text: str) -> DataFrame:
    """parse_outline over a table, a row for each node; null texts have none."""
    @F.pandas_udf("array<struct<id:string,parent:string,type:string,content:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [dict(zip(("id", "parent", "type", "content"), n, strict=True)) for n in parse_outline(x or "")])

    return df.select(key, F.explode(run(text)).alias("n")).select(key, "n.*")
