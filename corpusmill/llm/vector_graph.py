"""Embedding near-duplicates over a robust-pruned flat graph.

1. Distinct unit vectors get a node each; copies are counted on it.
2. Centres are a sample of the nodes, one for SHARD of them. Every node belongs to the shard of its nearest centre
   (home) and is a guest in the next nearest ones, so shards overlap. Where there are more than MOST_CENTRES centres,
   they are found in two steps: coarse centres first, then centres that are sampled and compared inside each coarse
   shard, so that neither a shard nor what one task holds of the centres grows with the table. A shard with many
   members is dealt to cells: its home nodes to blocks, its guests to slices, every slice with every block, so a
   cell has a bounded size and no pair of a shard is lost.
3. Build: in each cell the members' adjacency lists are robust-pruned (a candidate is left out if a neighbour
   already chosen is closer to it, by the factor ALPHA, than the node itself is). The lists of a node from all its
   cells are united.
4. Search: every member of a cell searches greedily from the cell's medoid over the united lists, then expands the
   range: from each node found within the threshold it goes on to that node's neighbours, until none is new. In each
   cell the searches of nodes with an id divisible by AUDIT are compared with all nodes of the cell; where the graph
   has missed a link of theirs, the whole cell is compared exhaustively, block by block.
5. Audit: the nodes with an id divisible by AUDIT are compared with all nodes of the table, in slices of them that are
   sent to all tasks. The links that the components lack are added; their share gives the recall. Below RECALL the
   graph is built anew over shards with more overlap.
6. Verify: the links found join nodes to components, distributed. Inside a component, block against slice, every
   product is taken anew in double precision; that counts the links of nodes whose shards differ too. Blocks whose
   members are all so close to a common member that every pair must link are counted without products.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_sized, lean, persisted

THRESHOLD = 0.9
#: Nodes aimed at in a shard; most centres that are compared at once (sampled by hash); members of a coarse shard in a part.
SHARD, MOST_CENTRES, PART = 400, 2048, 50_000
#: Coarse shards of a node at most.
COARSE = 4
#: A node belongs to its nearest shards, and to more whose centres are nearly as close as the nearest: (least, most), with more overlap where recall is below RECALL.
OVERLAPS, MARGIN, RECALL = ((4, 8), (12, 24), (48, 96)), 0.05, 0.95
#: Bytes of audited vectors that are sent to all tasks at once.
AUDIT_BYTES = 32 << 20
#: Home nodes and guests in a cell at most, about.
BLOCK, SLICE = 800, 1600
DEGREE, FAR, ALPHA, CANDIDATES, BEAM, AUDIT = 10, 3, 1.2, 32, 12, 20


def unit(values: list | None) -> bytes | None:
    """A vector scaled to length 1, as bytes; None for null, empty and zero vectors and those with null or non-finite components."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if not top:
        return None
    x = x / top
    return (x / np.sqrt((x * x).sum())).tobytes()


def _units(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([unit(v) for v in b.column(1).to_pylist()], pa.binary())], ["vec_id", "unit"])


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in column])


def _nearest(x: np.ndarray, centres: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, centre, product, whether it is the nearest) of each row's shards."""
    near = x @ centres.T
    first = np.argsort(-near, axis=1, kind="stable")[:, : min(most, len(centres))]
    close = np.take_along_axis(near, first, 1)
    member = close >= close[:, :1] - MARGIN
    member[:, :least] = True
    row, rank = np.nonzero(member)
    return row, first[row, rank], close[row, rank], rank == 0


def _assign(centres: np.ndarray, least: int, most: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                row, centre, _, home = _nearest(_matrix(b.column(1).to_pylist()), centres, least, most)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(centre.astype(np.int64)), pa.array(home)], ["node", "shard", "home"])

    return run


def _assign_fine(least: int, most: int):
    """Over rows (coarse, part, kind, node, unit) sorted by the first three, a coarse shard's centres (kind 0) before its members: the members' shards among those centres."""

    def run(batches):
        at, centres, ready = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            coarse, part, kind = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((coarse[1:] != coarse[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                units = b.column(4).slice(s, e - s).to_pylist()
                if at != (coarse[s], part[s]):
                    at, centres, ready = (coarse[s], part[s]), [], None
                if kind[s] == 0:
                    centres += units
                    continue
                ready = _matrix(centres) if ready is None else ready
                for k in range(0, len(units), 1024):
                    row, centre, near, _ = _nearest(_matrix(units[k : k + 1024]), ready, least, most)
                    nodes = b.column(3).slice(s + k, min(1024, e - s - k)).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([nodes, pa.array(int(coarse[s]) << 32 | centre.astype(np.int64)), pa.array(near)], ["node", "shard", "near"])

    return run


def _sample(nodes: DataFrame, n: int) -> np.ndarray:
    """The vectors of n nodes, the first in hash order."""
    return _matrix([r["unit"] for r in nodes.orderBy(F.xxhash64("unit"), "node").limit(n).collect()])


def _members(nodes: DataFrame, n: int, least: int, most: int) -> DataFrame:
    """(node, shard, home) of n nodes (node, unit)."""
    k, kind = max(1, round(n / SHARD)), "node long, shard long, home boolean"
    if k <= MOST_CENTRES:
        return persisted(nodes.select("node", "unit").mapInArrow(lean(_assign(_sample(nodes, k), least, most)), kind))
    coarse = min(MOST_CENTRES, math.ceil(math.sqrt(k)))
    of = persisted(nodes.select("node", "unit").mapInArrow(lean(_assign(_sample(nodes, coarse), 2, COARSE)), kind).select("node", F.col("shard").alias("coarse")))
    sizes = of.groupBy("coarse").agg(F.count("*").alias("size"))
    members = join_sized(of.join(nodes.select("node", "unit"), "node"), sizes, "coarse", "inner", 16)
    # a member in SHARD is a centre, or fewer where that gives many more than MOST_CENTRES; the one with the least hash always
    hashed = members.withColumn("h", F.xxhash64("unit", F.lit(1)) / F.lit(float(1 << 64)) + 0.5)
    sure = hashed.groupBy("coarse").agg(F.min("h").alias("low"))
    share = F.least(F.lit(1 / SHARD), F.lit(MOST_CENTRES) / F.col("size"))
    parts = F.ceil(F.col("size") / PART).cast("int")
    centres = persisted(join_sized(hashed, sure, "coarse", "inner", 16).where((F.col("h") < share) | (F.col("h") == F.col("low"))).select("coarse", "node", "unit", parts.alias("parts")))
    first = centres.select("coarse", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "node", "unit")
    rest = members.select("coarse", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), F.lit(1).alias("kind"), "node", "unit")
    met = first.unionByName(rest).repartition("coarse", "part").sortWithinPartitions("coarse", "part", "kind", F.xxhash64("unit"), "node")
    near = met.mapInArrow(lean(_assign_fine(least, most)), "node long, shard long, near double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("near")).alias("far"), "shard"))), 1, most)  # of at most COARSE * most
    every = near.groupBy("node").agg(best.alias("s")).select("node", F.posexplode("s").alias("rank", "s"))
    return persisted(every.select("node", F.col("s.shard").alias("shard"), (F.col("rank") == 0).alias("home")))


def robust_prune(x: np.ndarray, degree: int = DEGREE, far: int = FAR, alpha: float = ALPHA, candidates: int = CANDIDATES) -> np.ndarray:
    """[n, degree + far] places of neighbours (-1: none) among the rows of x, all rows at once: in each step every row takes its closest candidate left and drops those that this one occludes. The last `far` come, pruned likewise, from rows at random, so that tight groups stay reachable."""
    n = len(x)
    out = np.full((n, degree + far), -1, np.int32)
    if n < 2:
        return out
    x32 = x.astype(np.float32)
    rng = np.random.default_rng(n)
    for at in range(0, n, 512):
        rows = np.arange(at, min(n, at + 512))
        own = np.arange(len(rows))
        sims = x32[rows] @ x32.T
        sims[own, rows] = -2
        c = min(candidates, n - 1)
        nearest = np.argpartition(-sims, c - 1, axis=1)[:, :c]
        random = rng.integers(0, n - 1, (len(rows), 2 * far))
        random += random >= rows[:, None]
        for cand, first, most in ((nearest, 0, degree), (random, degree, far)):
            d = np.maximum(0, 2 - 2 * np.take_along_axis(sims, cand, 1))  # squared distances
            order = np.argsort(d, axis=1, kind="stable")
            cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
            between = np.maximum(0, 2 - 2 * np.matmul(x32[cand], x32[cand].transpose(0, 2, 1)))
            alive = np.ones(cand.shape, bool)
            for r in range(most):
                some = alive.any(1)
                pick = alive.argmax(1)
                out[rows, first + r] = np.where(some, cand[own, pick], -1)
                alive &= ~((alpha * alpha * between[own, pick] <= d) & some[:, None])
                alive[own, pick] = False
    return out


def _build(key, pdf: pd.DataFrame) -> pd.DataFrame:
    nodes = pdf["node"].to_numpy(np.int64)
    near = robust_prune(_matrix(pdf["unit"]))
    return pd.DataFrame({"node": nodes, "near": [nodes[r[r >= 0]] for r in near]})


def search(x: np.ndarray, lists: list[np.ndarray], start: int, q: int, threshold: float, beam: int = BEAM) -> np.ndarray:
    """Places of rows whose product with row q is at least threshold: greedy search from start with a beam, then expansion of the range. A search that hasn't come upon its own node by then goes on from there."""
    vector = x[q]
    seen = np.zeros(len(x), bool)
    seen[start] = True
    waiting = [(-float(x[start] @ vector), start)]  # a heap
    top: list[float] = []  # heap of the beam's products
    found: list[int] = []
    while True:
        while waiting:
            sim, i = heapq.heappop(waiting)
            sim = -sim
            if sim >= threshold:
                found.append(i)
            elif len(top) >= beam and sim < top[0]:
                waiting = []
                break
            near = lists[i]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for s, j in zip((x[near] @ vector).tolist(), near.tolist(), strict=True):
                if s >= threshold or len(top) < beam or s > top[0]:
                    heapq.heappush(waiting, (-s, j))
                    if s < threshold:
                        (heapq.heappush if len(top) < beam else heapq.heapreplace)(top, s)
        if q in found:
            return np.array(found)
        found, seen[q] = [], True
        seen[:] = False
        seen[q] = True
        waiting, top = [(-1.0, q)], []


CELL = "node long, root long, audited long, found long, exhaustive long"


def _search(threshold: float):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable").reset_index(drop=True)
        nodes, copies = pdf["node"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        target, searcher = pdf["target"].to_numpy(bool), pdf["searcher"].to_numpy(bool)
        x = _matrix(pdf["unit"])
        n = len(nodes)
        # united lists, as far as their nodes are in the cell, made mutual
        size = pdf["near"].map(len).to_numpy(np.int64)
        a, near = np.repeat(np.arange(n), size), np.concatenate([np.asarray(v, np.int64) for v in pdf["near"]])
        b = np.minimum(np.searchsorted(nodes, near), n - 1)
        a, b = a[nodes[b] == near], b[nodes[b] == near]
        pair = np.unique(np.concatenate([a * n + b, b * n + a]))
        lists = np.split(pair % n, np.searchsorted(pair // n, np.arange(1, n)))
        medoid = int(np.argmax(x @ x.mean(0)))
        queries = np.flatnonzero(searcher)
        found = [search(x, lists, medoid, q, threshold) for q in queries.tolist()]
        audited = np.flatnonzero(pdf["vec_id"].fillna(1).to_numpy(np.int64)[queries] % AUDIT == 0)
        truth = (x[queries[audited]] @ x.T >= threshold).sum(1)
        got = np.array([len(found[i]) for i in audited], np.int64)
        missed = bool((got < truth).any())
        if missed:
            found = [np.flatnonzero(row) for i in range(0, len(queries), 256) for row in x[queries[i : i + 256]] @ x.T >= threshold]
        root = list(range(n))

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for q, f in zip(queries.tolist(), found, strict=True):
            for j in f.tolist():
                i, j = top(q), top(j)
                if i != j:
                    root[max(i, j)] = min(i, j)
        out = pd.DataFrame({"node": nodes, "root": nodes[[top(i) for i in range(n)]], "audited": 0, "found": 0, "exhaustive": 0})
        out.loc[0, ["audited", "found", "exhaustive"]] = [int(truth.sum()), int(got.sum()), int(missed)]
        return out[(out["node"] != out["root"]) | (out.index == 0)]

    return run


def _count(threshold: float):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """Each searcher's links to the targets of a cell, itself left out."""
        target, searcher = pdf[pdf["target"]], pdf[pdf["searcher"]]
        links = np.zeros(len(searcher), np.int64)
        if len(target) and len(searcher):
            x, y = _matrix(target["unit"]), _matrix(searcher["unit"])
            copies = target["copies"].to_numpy(np.int64)
            # if all are within half the threshold's angle of one vector, every pair links
            pivot = x[0]
            least = min((x @ pivot).min(), (y @ pivot).min())
            if least > np.cos(np.arccos(threshold) / 2) + 1e-9:
                links[:] = copies.sum()
            else:
                for i in range(0, len(y), 512):
                    links[i : i + 512] = (y[i : i + 512] @ x.T >= threshold) @ copies
            same = dict(zip(target["node"], copies, strict=True))
            links -= np.array([same.get(v, 0) for v in searcher["node"]], np.int64)
        return pd.DataFrame({"node": searcher["node"].to_numpy(np.int64), "links": links})

    return run


def _cells(nodes: DataFrame, members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of each cell with their vectors. A home node is a target in its block, for every slice; every member is a searcher in its slice, for every block."""
    m = join_sized(members, sizes, "shard", "inner", 16)
    m = m.withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("s", F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int"))
    as_searcher = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.alias("block"), F.col("s").alias("slice")))
    as_target = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda k: F.struct(F.col("b").alias("block"), k.alias("slice")))
    m = m.withColumn("cell", F.explode(F.when(F.col("home"), F.array_union(as_searcher, as_target)).otherwise(as_searcher)))
    m = m.select("node", "shard", "cell.block", "cell.slice", (F.col("home") & (F.col("b") == F.col("cell.block"))).alias("target"), (F.col("s") == F.col("cell.slice")).alias("searcher"))
    return m.join(nodes, "node")


def _components_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    members = connected_components(edges)
    return persisted(nodes.join(members, "node", "left").select("node", "unit", "copies", "vec_id", "audited", F.coalesce("component", "node").alias("group")))


def _against_all(queries: list, threshold: float):
    """For (node, unit, group, copies): of each query its links in this task (copies counted) and, as rows of their own, the nodes that it links with in other components."""

    def run(batches):
        q = _matrix([r["unit"] for r in queries])
        node, group = np.array([r["node"] for r in queries]), np.array([r["group"] for r in queries])
        total, lost = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            own, of, copies = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2, 3))
            x = _matrix(b.column(1).to_pylist())
            for k in range(0, len(q), 512):
                hit = q[k : k + 512] @ x.T >= threshold
                hit &= node[k : k + 512, None] != own
                total[k : k + 512] += hit @ copies
                apart = hit & (group[k : k + 512, None] != of)
                if apart.any():
                    lost[k : k + 512] += apart @ copies
                    i, j = np.nonzero(apart)
                    _, first = np.unique(np.stack([i, of[j]]), axis=1, return_index=True)  # one link to a component will do
                    i, j = i[first], j[first]
                    yield pa.RecordBatch.from_arrays([pa.array(node[k + i]), pa.array(own[j]), pa.array(np.zeros(len(i), np.int64)), pa.array(np.zeros(len(i), np.int64))], ["src", "dst", "links", "lost"])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array([None] * len(some), pa.int64()), pa.array(total[some]), pa.array(lost[some])], ["src", "dst", "links", "lost"])

    return run


def _audit(of: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, links, lost): see _against_all; the audited nodes of each width against all nodes of it, slice by slice."""
    out = []
    for r in of.where("audited").groupBy(F.length("unit").alias("width")).agg(F.count("*").alias("n")).collect():
        slices = max(1, -(-r["n"] * r["width"] // AUDIT_BYTES))
        own = of.where(F.length("unit") == r["width"]).select("node", "unit", "group", "copies")
        for k in range(slices):
            queries = of.where("audited").where((F.length("unit") == r["width"]) & (F.pmod(F.xxhash64("node"), F.lit(slices)) == k)).select("node", "unit", "group").collect()
            if queries:
                out.append(persisted(own.mapInArrow(lean(_against_all(queries, threshold)), "src long, dst long, links long, lost long")))
    every = of.sparkSession.createDataFrame([], "src long, dst long, links long, lost long")
    for x in out:
        every = every.unionByName(x)
    return every


def _graph(nodes: DataFrame, sizes: dict[int, int], threshold: float, least: int, most: int) -> DataFrame:
    """CELL rows: what the searches over the graphs of all widths find."""
    every = nodes.sparkSession.createDataFrame([], CELL)
    for width, n in sizes.items():
        own = nodes.where(F.length("unit") == width)
        members = _members(own, n, least, most)
        cut = members.groupBy("shard").agg(F.count_if("home").alias("h"), F.count("*").alias("m"))
        cut = persisted(cut.select("shard", F.greatest(F.lit(1), F.ceil(F.col("h") / BLOCK)).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("m") / SLICE)).cast("int").alias("slices")))
        cells = _cells(own.select("node", "unit", "copies", "vec_id"), members, cut)
        built = cells.groupBy("shard", "block", "slice").applyInPandas(_build, "node long, near array<long>")
        lists = persisted(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
        every = every.unionByName(persisted(cells.join(lists, "node").groupBy("shard", "block", "slice").applyInPandas(_search(threshold), CELL)))
    return every


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(result, audit). result: vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding array). audit, one row for each graph that was built: least (shards of a node), links of the audited nodes with all others, lost (those that the graph's components lacked; they were added), recall.

    Null and empty vectors, zero vectors and those with null or non-finite components link with nothing and are
    their own component; vectors of different lengths never link. Equal vectors meet by an aggregation before any
    are compared. Rows that repeat a vec_id are vectors of their own that share an id. A null vec_id counts as a
    vector; a component's id is its smallest non-null one. Other columns are ignored. Empty table: empty result.
    """
    spark = vectors.sparkSession
    rows = persisted(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(lean(_units), "vec_id long, unit binary"))
    grouped = rows.where("unit is not null").groupBy("unit").agg(F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"), F.coalesce(F.bool_or(F.col("vec_id") % AUDIT == 0), F.lit(False)).alias("audited"))
    nodes = persisted(grouped.withColumn("node", F.monotonically_increasing_id()))
    sizes = {r["w"]: r["n"] for r in nodes.groupBy(F.length("unit").alias("w")).agg(F.count("*").alias("n")).orderBy("w").limit(1001).collect()}
    if len(sizes) > 1000:
        raise ValueError("more than 1,000 vector lengths")
    edges, log = spark.createDataFrame([], "src long, dst long"), []
    for least, most in OVERLAPS:
        found = _graph(nodes, sizes, threshold, least, most)
        edges = edges.unionByName(found.where("node != root").select(F.col("node").alias("src"), F.col("root").alias("dst")))
        of = _components_of(nodes, edges)
        audited = _audit(of, threshold)
        total = audited.agg(F.coalesce(F.sum("links"), F.lit(0)).alias("links"), F.coalesce(F.sum("lost"), F.lit(0)).alias("lost")).first()
        log.append((least, total["links"], total["lost"], 1 - total["lost"] / max(1, total["links"])))
        if total["lost"]:
            edges = edges.unionByName(audited.where("dst is not null").select("src", "dst"))
            of = _components_of(nodes, edges)
        if log[-1][-1] >= recall:
            break
    groups = persisted(of.groupBy("group").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("size")))
    linked = groups.where("size > 1").select(F.col("group").alias("shard"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("size") / SLICE).cast("int").alias("slices"))
    grouped = join_sized(of, linked.select(F.col("shard").alias("group")), "group", "left_semi", 8).select("node", F.col("group").alias("shard"), F.lit(True).alias("home"))
    counted = _cells(of.select("node", "unit", "copies"), grouped, linked).groupBy("shard", "block", "slice").applyInPandas(_count(threshold), "node long, links long")
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    of = of.join(links, "node", "left").join(groups, "group").select("unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    result = rows.join(of, "unit", "left")
    known = F.col("n_links").isNotNull()
    result = result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(known, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    audit = spark.createDataFrame(log, "least int, links long, lost long, recall double")
    return result.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), audit
