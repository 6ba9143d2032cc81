"""Exact top-k inner-product search: a ball tree in every shard, branch and bound across them."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochlane.session import materialise

ROWS_PER_SHARD = 4096
#: Queries that a copy of a tree serves, and roots that they are held against at once: half a million pairs.
QUERIES_PER_BLOCK = 16_384
ROOTS_PER_BUNDLE = 32
#: The space is cut into cells by a sample of at most so many rows, into at most so many cells a length of vectors.
SAMPLE, MOST_CELLS = 20_000, 1024
#: Shards of the largest bounds that a query visits before the others.
NEAR = 4
LEAF = 64
SCALE = 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole(vector: Column) -> Column:
    """floor(256 x) of each component, cut to the range of a long; null for vectors that are null or hold null or non-finite ones."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * SCALE).cast("long")))


class BallTree:
    """Rows in leaf order; each node has its range of rows, centre, radius and children."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order, nodes = np.arange(len(ids)), []
        real = rows.astype(np.float64)
        todo = [(0, len(ids), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            own = real[order[lo:hi]]
            centre = own.mean(axis=0)
            gap = np.sqrt(((own - centre) ** 2).sum(axis=1))
            me = len(nodes)
            nodes.append([lo, hi, -1, -1, centre, float(gap.max(initial=0))])
            if parent >= 0:
                nodes[parent][2 + side] = me
            if hi - lo > LEAF and nodes[me][5] > 0:
                a = own[gap.argmax()]
                from_a = ((own - a) ** 2).sum(axis=1)
                b = own[from_a.argmax()]
                cut = np.argsort(own @ (b - a), kind="stable")
                order[lo:hi] = order[lo:hi][cut]
                mid = (lo + hi) // 2
                todo += [(lo, mid, me, 0), (mid, hi, me, 1)]
        self.ids, self.rows = ids[order], rows[order]
        self.span = np.array([n[:4] for n in nodes])
        self.centre, self.radius = np.array([n[4] for n in nodes]), np.array([n[5] for n in nodes])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[int, int, int]]:
        """(query_id, vec_id, score) of up to k best rows of each query that reach its floor.

        A node's bound is q c + |q| r; nodes are opened from the largest bound on, until it
        is below the kth score so far, which starts at the floor that other shards share."""
        q = queries.astype(np.float64)
        bounds = upper_bounds(q, self.centre, self.radius)
        largest = float(np.abs(self.rows.astype(np.float64)).max(initial=0)) * max(1.0, float(np.abs(q).max(initial=0))) * max(1, q.shape[1])
        exact = largest < 2**52
        rows = self.rows.astype(np.float64) if exact else self.rows.astype(object)
        out = []
        for i, (own, start) in enumerate(zip(query_ids.tolist(), floor.tolist(), strict=True)):
            best: list[tuple[int, int]] = []  # a heap of (score, -vec_id), the worst first
            vec, bound = (q[i] if exact else queries[i].astype(object)), bounds[i]
            heap = [(-bound[0], 0)]
            while heap:
                top, node = heapq.heappop(heap)
                least = max(start, best[0][0]) if len(best) == k else start
                if -top < least:
                    break
                lo, hi, left, right = self.span[node].tolist()
                if left >= 0:
                    heapq.heappush(heap, (-bound[left], left))
                    heapq.heappush(heap, (-bound[right], right))
                    continue
                scores = rows[lo:hi] @ vec if exact else np.array([min(MOST, max(LEAST, int(x))) for x in rows[lo:hi] @ vec], object)
                for j in np.flatnonzero(scores >= least).tolist():
                    vec_id = int(self.ids[lo + j])
                    if vec_id != own:
                        (heapq.heappush if len(best) < k else heapq.heappushpop)(best, (int(scores[j]), -vec_id))
            out += [(own, -v, s) for s, v in best]
        return out


def upper_bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each query and ball at least the largest inner product in the ball, as it is after cutting to a long's range."""
    size = np.linalg.norm(q, axis=1)[:, None]
    reach = size * radii
    return np.maximum(q @ centres.T + reach + 1e-9 * (size * np.linalg.norm(centres, axis=1) + reach) + 1e-6, float(LEAST))


class Cells:
    """The space cut by planes, each through the middle of the sampled rows on its side: neighbours share a cell."""

    def __init__(self, sample: np.ndarray, n_cells: int) -> None:
        self.planes: list[tuple[np.ndarray, float, int, int]] = []
        self.n = 0
        self.root = self._cut(sample.astype(np.float64), n_cells)

    def _cut(self, rows: np.ndarray, n_cells: int) -> int:
        """The node of a part: a plane's number, or -1 less a cell's."""
        far = rows[((rows - rows.mean(axis=0)) ** 2).sum(axis=1).argmax()] if len(rows) > 1 else None
        if n_cells > 1 and far is not None:
            other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
            along = rows @ (other - far)
            middle = float(np.median(along))
            low = along < middle
            if low.any():
                me = len(self.planes)
                self.planes.append((other - far, middle, 0, 0))
                a = self._cut(rows[low], n_cells // 2)
                b = self._cut(rows[~low], n_cells - n_cells // 2)
                self.planes[me] = (other - far, middle, a, b)
                return me
        self.n += 1
        return -self.n

    def of(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.root)
        for me, (direction, middle, a, b) in enumerate(self.planes):  # a plane comes before those below it
            here = np.flatnonzero(out == me)
            if len(here):
                out[here] = np.where(rows[here] @ direction < middle, a, b)
        return -1 - out


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.int64).reshape(len(vectors), -1)


def _with_cells(rows: DataFrame, n: int) -> DataFrame:
    """rows (id, v, q, dim) with cell, from planes that a sample of at most SAMPLE rows or so gives."""
    size = F.lit(float(1 << 40) * min(1.0, SAMPLE / max(1, n)))
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40)) < size).select("dim", "v").limit(2 * SAMPLE).collect()
    of_dim: dict[int, list] = {}
    for r in sample:
        of_dim.setdefault(r["dim"], []).append(r["v"])
    cells = {d: Cells(np.array(v), max(1, min(MOST_CELLS, round(len(v) / max(1, len(sample)) * n / ROWS_PER_SHARD)))) for d, v in of_dim.items() if d}
    sent = rows.sparkSession.sparkContext.broadcast(cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            v, out = batch.column("v"), np.zeros(len(dim), np.int32)
            flat, starts = v.values.to_numpy(), v.offsets.to_numpy()
            for d in np.unique(dim).tolist():
                if d in sent.value:
                    own = np.flatnonzero(dim == d)
                    out[own] = sent.value[d].of(flat[starts[own][:, None] + np.arange(d)].astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "cell"])

    return rows.mapInArrow(assign, "id long, v array<long>, q boolean, dim int, cell int")


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query row.

    Components are floor(256 x). Candidates are all rows of the query's length but those of
    its own id; ties go to the smaller id; with fewer than k candidates all come back. Rows
    with a null id or a vector that is null or holds null or non-finite components take no
    part. Repeated rows are one query, but each is a candidate. No row: an empty table.

    Components and scores beyond the range of a long are cut to its ends.

    Rows are dealt into shards by the cell of space they are in, a crowded cell into several, with
    one tree each. A query first searches a shard of its own cell; the kth score is then its floor.
    Its block is held against the roots of all trees, and only shards whose bound reaches the floor
    are visited: the NEAR best first, whose scores raise the floor for the rest."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and v is not null").withColumn("dim", F.size("v"))
    rows = materialise(rows)
    n = rows.count()
    rows = materialise(_with_cells(rows, n))
    counts = materialise(rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / ROWS_PER_SHARD).cast("int").alias("parts")))
    at = rows.join(F.broadcast(counts), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))  # at most MOST_CELLS rows a length
    keys = ["dim", "cell", "part"]

    def plant(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        tree = BallTree(group["id"].to_numpy(np.int64), _matrix(group["v"]))
        return pd.DataFrame({**{c: [group[c].iloc[0]] for c in keys}, "centre": [tree.centre[0].tolist()], "radius": [float(tree.radius[0])], "tree": [pickle.dumps(tree)]})

    trees = materialise(at.select("id", "v", *keys).groupBy(*keys).applyInPandas(plant, "dim int, cell int, part int, centre array<double>, radius double, tree binary"))
    asked = at.where("q").select("id", "v", *keys).distinct()
    n_queries, n_roots = asked.count(), trees.count()
    blocks, bundles = max(1, -(-n_queries // QUERIES_PER_BLOCK)), max(1, -(-n_roots // ROOTS_PER_BUNDLE))
    queries = materialise(asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        found = pickle.loads(left["tree"].iloc[0]).search(right["id"].to_numpy(np.int64), _matrix(right["v"]), k, right["floor"].to_numpy(np.int64))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    def run(wanted: DataFrame) -> DataFrame:
        # a group is one tree and one block of queries, however many of either there are
        pairs = wanted.select(*[F.col(c).alias(f"p_{c}") for c in (*keys, "block")]).distinct()
        grown = trees.join(pairs, [F.col(c) == F.col(f"p_{c}") for c in keys]).select(*keys, F.col("p_block").alias("block"), "tree")
        return materialise(grown.groupBy(*keys, "block").cogroup(wanted.select("id", "v", "floor", *keys, "block").groupBy(*keys, "block")).applyInPandas(search, "query_id long, vec_id long, score long"))

    def floors(found: DataFrame) -> DataFrame:
        best = found.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("_r") == k)
        return best.select(F.col("query_id").alias("id"), F.col("score").alias("floor"))

    lowest = F.lit(LEAST).cast("long")
    first = run(queries.withColumn("floor", lowest))
    known = queries.join(floors(first), "id", "left").withColumn("floor", F.coalesce("floor", lowest))

    def bound(left: pa.Table, right: pa.Table) -> pa.Table:
        # pairs stay in arrays; a group has QUERIES_PER_BLOCK times ROOTS_PER_BUNDLE of them, about
        grid = lambda c, n: c.combine_chunks().flatten().to_numpy().reshape(n, -1).astype(np.float64)
        own = {c: left[c].to_numpy() for c in ("floor", "cell", "part")}
        good = np.zeros((len(left), len(right)), bool)
        reach, cell, part = np.zeros(good.shape), right["cell"].to_numpy(), right["part"].to_numpy()
        if good.size:
            reach = upper_bounds(grid(left["v"], len(left)), grid(right["centre"], len(right)), right["radius"].to_numpy())
            floor = own["floor"].astype(float)
            good = reach >= (floor * (1 - 1e-9 * np.sign(floor)))[:, None]
            good &= (cell != own["cell"][:, None]) | (part != own["part"][:, None])
        _, j = np.nonzero(good)
        each = pa.StructArray.from_arrays([pa.array(reach[good]), pa.array(cell[j], pa.int32()), pa.array(part[j], pa.int32())], names=["bound", "cell", "part"])
        targets = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(good.sum(axis=1)))), pa.int32()), each)
        return left.select(["id", "dim", "v", "block"]).append_column("targets", targets)

    roots = trees.select(*keys, "centre", "radius", F.pmod(F.xxhash64(*keys), F.lit(bundles)).cast("int").alias("bundle"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    sent = known.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))))
    group = ["dim", "block", "bundle"]
    reach = materialise(sent.groupBy(*group).cogroup(roots.groupBy(*group)).applyInArrow(bound, "id long, dim int, v array<long>, block int, targets array<struct<bound: double, cell: int, part: int>>"))
    best = F.reverse(F.array_sort("targets"))
    to = lambda df: df.withColumn("_t", F.explode("_targets")).select("id", "v", "dim", "_t.cell", "_t.part", "block", "floor")
    near = run(to(reach.withColumn("_targets", F.slice(best, 1, NEAR)).join(known.select("id", "floor").distinct(), "id")))
    raised = floors(first.union(near))
    later = reach.join(raised, "id", "left").withColumn("floor", F.coalesce("floor", lowest))
    rest = F.filter(F.slice(best, F.lit(NEAR + 1), F.greatest(F.size("targets"), F.lit(1))), lambda t: t["bound"] >= F.col("floor") - F.abs(F.col("floor").cast("double")) * 1e-9)
    found = first.union(near).union(run(to(later.withColumn("_targets", rest))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
