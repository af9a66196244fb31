"""Exact top-k inner products by dual-tree search over cover trees.

Queries and data are indexed alike.  The upper level is a net of centres,
chosen farthest-first on a bounded sample; every vector of the table joins its
nearest centre's cell and every cell keeps its true covering radius.  For a
query cell (centre c, radius r) and a data cell (d, s) no inner product is
above ``c.d + r|d| + s|c| + rs``.  A first round searches each query cell's
most promising data cells; the second only those pairs of cells whose bound
reaches the worst k-th score of the query cell.  Inside a task, both sides are
cover trees again (each child covers half its parent's radius) and pairs of
nodes are pruned by the same bound against the query node's worst k-th score.

Scale: cells are dealt into blocks of at most about ``block_rows`` vectors and
queries into chunks of ``chunk_rows``, so a task holds one block and one chunk
whatever the cell's share of the table.  The driver sees the sample
(``sample_rows``), the centres (``max_cells``) and one summary per cell.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertsieve.llm.common import paths_table

SAMPLE_ROWS = 4096
MAX_CELLS = 256
BLOCK_ROWS = 2048
CHUNK_ROWS = 4096
LEAF = 24
NO_SCORE = np.iinfo(np.int64).min


def matrix(vectors, dim: int) -> np.ndarray:
    """An Arrow list column as int64 rows of ``dim`` (missing components 0)."""
    out = np.zeros((len(vectors), dim), dtype=np.int64)
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(flat):
        out[np.arange(dim) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` and ``b``, exact; beyond 64
    bits they stop at the largest or smallest long."""
    most = (np.abs(a.astype(float)).max(initial=0) * np.abs(b.astype(float)).max(initial=0) * max(1, a.shape[1]))
    if most < 2.0 ** 52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, NO_SCORE + 1, np.iinfo(np.int64).max).astype(np.int64)


def farthest_first(points: np.ndarray, most: int, radius: float = 0.0, first: int = 0):
    """Indices of a net: each next centre is the point farthest from the
    others, until all points are within ``radius`` or there are ``most``.
    Also each point's centre (position in the net) and its distance."""
    dist = np.linalg.norm(points - points[first], axis=1)
    owner, net = np.zeros(len(points), dtype=np.int64), [first]
    while len(net) < most:
        far = int(np.argmax(dist))
        if dist[far] <= radius:
            break
        new = np.linalg.norm(points - points[far], axis=1)
        closer = new < dist
        owner[closer], dist[closer] = len(net), new[closer]
        net.append(far)
    return np.array(net), owner, dist


class CoverTree:
    """Nodes as arrays: ``center``, ``radius`` (covers every descendant),
    ``children`` (first, count) or, for leaves, ``rows`` of the points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.center, self.radius, self.children, self.rows = [], [], [], []
        everyone = np.arange(len(points))
        self._add(everyone, 0)
        todo = [0]
        while todo:
            at = todo.pop()
            rows = self.rows[at]
            if len(rows) <= leaf or self.radius[at] == 0:
                continue
            own = int(np.flatnonzero(rows == self.center[at])[0])  # a node is its own first child
            net, owner, _ = farthest_first(points[rows], len(rows), self.radius[at] / 2, own)
            start = len(self.center)
            order = np.argsort(owner, kind="stable")
            parts = np.split(rows[order], np.cumsum(np.bincount(owner, minlength=len(net)))[:-1])
            for i, part in zip(net, parts):
                self._add(part, int(rows[i]))
            self.children[at] = (start, len(net))
            self.rows[at] = None
            todo += range(start, len(self.center))
        self.radius = np.array(self.radius)
        self.first = np.array([c[0] if c else -1 for c in self.children])
        self.count = np.array([c[1] if c else 0 for c in self.children])
        self.centers = points[np.array(self.center)]
        self.norms = np.linalg.norm(self.centers, axis=1)

    def _add(self, rows: np.ndarray, center: int) -> None:
        self.center.append(center)
        self.radius.append(float(np.linalg.norm(self.points[rows] - self.points[center], axis=1).max()))
        self.children.append(None)
        self.rows.append(rows)

    def below(self, node: int) -> np.ndarray:
        """Rows of all points under a node."""
        if self.rows[node] is not None:
            return self.rows[node]
        start, n = self.children[node]
        return np.concatenate([self.below(i) for i in range(start, start + n)])


def _expand(tree: CoverTree, nodes: np.ndarray) -> np.ndarray:
    """Children of the inner nodes, and the leaves themselves."""
    inner = nodes[tree.count[nodes] > 0]
    kids = [np.arange(tree.first[n], tree.first[n] + tree.count[n]) for n in inner]
    return np.concatenate([nodes[tree.count[nodes] == 0], *kids])


class DualSearch:
    """Top-k of query rows over data rows; ``floor`` are scores each query
    already reaches k times (pairs below them are of no use)."""

    def __init__(self, q_ids, queries, d_ids, data, k: int, floor):
        self.q_ids, self.queries, self.k = q_ids, queries, k
        order = np.argsort(d_ids, kind="stable")
        self.d_ids, self.data = d_ids[order], data[order]
        self.floor = floor
        self.scores = np.full((len(q_ids), k), NO_SCORE, dtype=np.int64)
        self.ids = np.full((len(q_ids), k), np.iinfo(np.int64).max, dtype=np.int64)
        self.qt, self.dt = CoverTree(queries.astype(float)), CoverTree(self.data.astype(float))
        self.under = {}

    def run(self):
        self._visit(0, np.array([0]))
        return self.scores, self.ids

    def _worst(self, node: int) -> int:
        if node not in self.under:
            self.under[node] = self.qt.below(node)
        rows = self.under[node]
        return int(np.maximum(self.scores[rows, -1], self.floor[rows]).min())

    def _bounds(self, node: int, nodes: np.ndarray) -> np.ndarray:
        q, d = self.qt, self.dt
        r, norm = q.radius[node], q.norms[node]
        bound = d.centers[nodes] @ q.centers[node] + r * d.norms[nodes] + d.radius[nodes] * (norm + r)
        # whole-number scores: half a unit, and the rounding of very large ones
        return bound + 0.5 + 1e-9 * (norm + r) * (d.norms[nodes] + d.radius[nodes])

    def _visit(self, node: int, nodes: np.ndarray) -> None:
        nodes = nodes[self._bounds(node, nodes) >= self._worst(node)]
        if not len(nodes):
            return
        if self.qt.count[node]:
            wide = self.dt.radius[nodes] >= self.qt.radius[node] / 2
            nodes = np.concatenate([nodes[~wide], _expand(self.dt, nodes[wide])]) if wide.any() else nodes
            start = self.qt.first[node]
            for child in range(start, start + self.qt.count[node]):
                self._visit(child, nodes)
            return
        while len(nodes):
            bounds = self._bounds(node, nodes)
            stay = bounds >= self._worst(node)
            nodes, bounds = nodes[stay], bounds[stay]
            if not len(nodes):
                return
            if (self.dt.count[nodes] > 0).any():
                nodes = _expand(self.dt, nodes)
                continue
            nodes = nodes[np.argsort(-bounds, kind="stable")]
            sizes = np.cumsum([len(self.dt.rows[n]) for n in nodes])
            take = max(1, int(np.searchsorted(sizes, 256)))
            self._score(self.qt.rows[node], np.concatenate([self.dt.rows[n] for n in nodes[:take]]))
            nodes = nodes[take:]

    def _score(self, q_rows: np.ndarray, d_rows: np.ndarray) -> None:
        found = products(self.queries[q_rows], self.data[d_rows])
        ids = np.broadcast_to(self.d_ids[d_rows], found.shape)
        own = ids == self.q_ids[q_rows][:, None]
        found = np.where(own, NO_SCORE, found)
        scores = np.concatenate([self.scores[q_rows], found], axis=1)
        ids = np.concatenate([self.ids[q_rows], np.where(own, np.iinfo(np.int64).max, ids)], axis=1)
        order = np.lexsort((ids, -scores.astype(float) if abs(scores[scores > NO_SCORE]).max(initial=0) < 2 ** 52
                            else ~scores), axis=1)[:, :self.k]
        self.scores[q_rows] = np.take_along_axis(scores, order, axis=1)
        self.ids[q_rows] = np.take_along_axis(ids, order, axis=1)


def _net(spark, vectors: DataFrame, dim: int, n: int, sample_rows: int, max_cells: int, block_rows: int):
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow()
    points = matrix(sample["v"].combine_chunks(), dim).astype(float)
    cells = max(1, min(max_cells, -(-n // block_rows), len(points)))
    return points[farthest_first(points, cells)[0]]


def top_k(table: DataFrame, is_query, *, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, max_cells: int = MAX_CELLS,
          block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Each query row's ``k`` best rows by inner product of
    ``floor(scale * x)``: ``query_id, rank, vec_id, score``.

    ``is_query`` is a column expression over ``vec_id``.  Candidates are all
    rows but the query's own; ties go to the smaller id; fewer candidates than
    ``k``: all of them.  Vectors that are null or hold null or non-finite
    components, and null ids, take no part.  An id given several times counts
    once, with its smallest vector.  Of vectors of different lengths the
    missing components count as 0.  No queries or no rows: an empty result.
    """
    spark = table.sparkSession
    e = F.col(vector_col)
    finite = F.forall(e, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    # narrow first: the rest of the work never sees the other columns
    vectors = (table.where(F.col(id_col).isNotNull() & e.isNotNull()).where(finite)
               .select(F.col(id_col).cast("long").alias("vec_id"),
                       F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
               .groupBy("vec_id").agg(F.min("v").alias("v")))
    vectors = paths_table(vectors, "topk-vectors")
    n, dim = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n:
        return empty
    net = _net(spark, vectors, dim, n, sample_rows, max_cells, block_rows)
    centers = spark.sparkContext.broadcast(net)  # at most max_cells vectors

    def place(batches):
        import pyarrow as pa

        c = centers.value
        for batch in batches:
            points = matrix(batch["v"], dim).astype(float)
            dist = np.empty((len(points), len(c)))
            for i, center in enumerate(c):
                dist[:, i] = np.linalg.norm(points - center, axis=1)
            cell = dist.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["v"], pa.array(cell.astype(np.int32)),
                 pa.array(dist[np.arange(len(cell)), cell])], ["vec_id", "v", "cell", "dist"])

    placed = paths_table(vectors.mapInArrow(place, "vec_id long, v array<long>, cell int, dist double"), "topk-cells")
    queries = placed.where(is_query)
    summary = (F.count(F.lit(1)).alias("n"), F.max("dist").alias("r"))
    data_cells = {r.cell: r for r in placed.groupBy("cell").agg(*summary).collect()}
    query_cells = {r.cell: r for r in queries.groupBy("cell").agg(*summary).collect()}
    if not query_cells:
        return empty
    n_chunks = -(-sum(r.n for r in query_cells.values()) // chunk_rows)
    blocks = spark.createDataFrame([(c, -(-r.n // block_rows)) for c, r in data_cells.items()], "cell int, blocks int")

    d_cell = np.array(sorted(data_cells))
    d_rad = np.array([data_cells[c].r for c in d_cell])
    d_norm = np.linalg.norm(net[d_cell], axis=1)
    bounds = {}
    for c, r in query_cells.items():
        size = float(np.linalg.norm(net[c]))
        bounds[c] = net[d_cell] @ net[c] + r.r * d_norm + d_rad * (size + r.r) + 1.0
        bounds[c] += 1e-9 * (size + r.r) * (d_norm + d_rad)

    def search(left, right):
        """``left``: queries with their floors; ``right``: one block of data."""
        import pyarrow as pa

        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 3, names)
        left, right = left.combine_chunks(), right.combine_chunks()
        q_ids = left["query_id"].to_numpy()
        scores, ids = DualSearch(q_ids, matrix(_one(left["q_v"]), dim), right["vec_id"].to_numpy(),
                                 matrix(_one(right["v"]), dim), k, left["floor"].to_numpy()).run()
        real = (scores > NO_SCORE) & (scores >= left["floor"].to_numpy()[:, None])
        row, _ = np.nonzero(real)
        return pa.Table.from_arrays([pa.array(q_ids[row]), pa.array(ids[real]), pa.array(scores[real])], names)

    sub = placed.join(F.broadcast(blocks), "cell")  # one row a cell, at most max_cells
    data = sub.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"),
                      F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"))

    def run(queries_now: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
        """Partial results of the (query cell, data cell) pairs."""
        goes = spark.createDataFrame(pairs, "q int, cell int").join(F.broadcast(blocks), "cell")
        chunk = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(n_chunks)).cast("int")
        asked = (queries_now.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q_v"), "floor",
                                    F.col("cell").alias("q"))
                 .join(goes, "q")
                 .select("query_id", "q_v", "floor", "cell",
                         F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), chunk.alias("chunk")))
        used = spark.createDataFrame(sorted({(p[1],) for p in pairs}), "cell int")
        keys = ("cell", "block", "chunk")
        return (asked.groupBy(*keys).cogroup(data.join(F.broadcast(used), "cell").groupBy(*keys))
                .applyInArrow(search, "query_id long, vec_id long, score long"))

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    floorless = queries.withColumn("floor", F.lit(int(NO_SCORE)).cast("long"))
    first_pairs = []
    for c, bound in bounds.items():
        have = 0
        for i in np.argsort(-bound, kind="stable"):
            first_pairs.append((int(c), int(d_cell[i])))
            have += data_cells[int(d_cell[i])].n
            if have > 2 * k:
                break
    first = paths_table(best(run(floorless, first_pairs)), "topk-first")
    reached = (queries.select("vec_id", "v", "cell").join(
        first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor")),
        "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(int(NO_SCORE)).cast("long"))))
    worst = {r.cell: r.w for r in reached.groupBy("cell").agg(F.min("floor").alias("w")).collect()}
    done = set(first_pairs)
    second_pairs = [(int(c), int(d)) for c, bound in bounds.items() for d, b in zip(d_cell, bound)
                    if b >= worst[c] and (int(c), int(d)) not in done]
    found = first.select("query_id", "vec_id", "score")
    if second_pairs:
        found = found.unionByName(run(reached, second_pairs))
    return best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _one(column):
    """A table column as one array."""
    import pyarrow as pa

    return pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
