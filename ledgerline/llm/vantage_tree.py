"""Nearest neighbours by vantage-point trees, one per shard.

Shards: every vector goes to the cell of its nearest pivot (pivots: at most
``MAX_PIVOTS`` vectors, a bounded sample by hash); a cell of more than
``SHARD_ROWS`` rows is cut into shards by a hash of the id, so a vector that a
third of the rows share fills many shards, not one. Each shard becomes a
vantage-point tree, one row of an index table: every row is indexed. Equal
vectors are one point of the tree with its smallest k + 1 ids, which is all
that a k-nearest result can name.

Search: queries are sent in blocks of at most ``QUERY_BLOCK`` to shards, first
to those of their own cell, which bounds the distance of the k-th neighbour;
then to the cells that the triangle inequality cannot rule out. Inside a tree
the same inequality prunes a branch if ``factor`` times its lower bound is
above the k-th distance so far. Factor one is exact; a larger factor prunes
more and may lose neighbours (recall is measured by a test).

Defined results: null ids and vectors that are null, empty, zero or hold null
or non-finite components take no part; vectors of another dimension are never
neighbours; of rows with the same id one counts (the smallest hash); ties go
to smaller ids; fewer candidates give fewer rows; empty tables give empty
results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import sized, staged, table

MAX_PIVOTS = 256
SHARD_ROWS = 4096
QUERY_BLOCK = 2048
LEAF = 64
K_NEAREST = 10
#: Above one: approximate. Recall of the query at this factor is in the README.
FACTOR = 1.1
_NODE = 6  # first row, end, middle, radius inside (least, most), least outside


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, row by row of ``a``."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def build(vecs: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[tuple[int, int], tuple]]:
    """Order of the rows and the nodes of a tree. A node covers order[lo:hi];
    its vantage point stands first, the inner half up to ``mid`` next."""
    order = np.arange(len(vecs))
    nodes: dict[tuple[int, int], tuple] = {}
    todo = [(0, len(vecs))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= leaf:
            continue
        d = distances(vecs[order[lo:lo + 1]], vecs[order[lo + 1:hi]])[0]
        rank = np.argsort(d, kind="stable")
        order[lo + 1:hi] = order[lo + 1:hi][rank]
        d = d[rank]
        half = len(d) // 2
        mid = lo + 1 + half
        nodes[(lo, hi)] = (mid, d[0], d[half - 1], d[half], d[-1])
        todo += [(lo + 1, mid), (mid, hi)]
    return order, nodes


class Tree:
    def __init__(self, ids: np.ndarray, vecs: np.ndarray, counts: np.ndarray, nodes: dict):
        self.vecs, self.nodes = vecs, nodes
        self.ids, self.first = ids, np.concatenate(([0], np.cumsum(counts)))

    def search(self, qid: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, factor: float):
        """(distances, ids), each queries x k; missing places are infinite.
        ``bound``: distances above it are of no use to a query."""
        best = np.full((len(q), k), np.inf)
        who = np.full((len(q), k), np.iinfo(np.int64).max)

        def offer(rows: np.ndarray, lo: int, hi: int, d: np.ndarray) -> None:
            a, b = self.first[lo], self.first[hi]
            ids = self.ids[a:b]
            each = np.repeat(np.arange(hi - lo), np.diff(self.first[lo:hi + 1]))
            dd = d[:, each]
            dd = np.where(ids[None, :] == qid[rows][:, None], np.inf, dd)
            all_d = np.concatenate((best[rows], dd), axis=1)
            all_i = np.concatenate((who[rows], np.broadcast_to(ids, dd.shape)), axis=1)
            at = np.lexsort((all_i, all_d), axis=1)[:, :k]
            best[rows] = np.take_along_axis(all_d, at, axis=1)
            who[rows] = np.take_along_axis(all_i, at, axis=1)

        def useful(rows: np.ndarray, low: np.ndarray) -> np.ndarray:
            limit = np.minimum(best[rows, -1], bound[rows])
            return rows[low * factor <= limit * (1 + 1e-9) + 1e-12]

        def visit(lo: int, hi: int, rows: np.ndarray) -> None:
            if hi <= lo or not len(rows):
                return
            node = self.nodes.get((lo, hi))
            if node is None:
                offer(rows, lo, hi, distances(q[rows], self.vecs[lo:hi]))
                return
            mid, in0, in1, out0, out1 = node
            d = distances(q[rows], self.vecs[lo:lo + 1])
            offer(rows, lo, lo + 1, d)
            d = d[:, 0]
            low_in = np.maximum(np.maximum(d - in1, in0 - d), 0)
            low_out = np.maximum(np.maximum(d - out1, out0 - d), 0)
            near_in = low_in <= low_out
            # nearer half first; what is found there prunes the other half
            visit(lo + 1, mid, useful(rows[near_in], low_in[near_in]))
            visit(mid, hi, useful(rows[near_in], low_out[near_in]))
            visit(mid, hi, useful(rows[~near_in], low_out[~near_in]))
            visit(lo + 1, mid, useful(rows[~near_in], low_in[~near_in]))

        visit(0, len(self.vecs), np.arange(len(q)))
        return best, who


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _build_shard(t: pa.Table) -> pa.Table:
    vecs, ids = _matrix(t.column("vec")), t.column("id").to_numpy()
    points, of = np.unique(vecs, axis=0, return_inverse=True)
    by = np.lexsort((ids, of.ravel()))
    rank = np.arange(len(by)) - np.searchsorted(of.ravel()[by], of.ravel()[by])
    by = by[rank <= K_NEAREST]
    counts = np.bincount(of.ravel()[by], minlength=len(points))
    start = np.concatenate(([0], np.cumsum(counts)))
    order, nodes = build(points)
    ids = np.concatenate([ids[by[start[i]:start[i + 1]]] for i in order])
    flat = np.array([[lo, hi, *v] for (lo, hi), v in nodes.items()], dtype=np.float64).reshape(-1, 7)
    one = lambda x: pa.array([x.tobytes()], pa.binary())
    return pa.table([t.column("cell")[:1], t.column("sub")[:1], pa.array([points.shape[1]], pa.int32()),
                     one(ids.astype(np.int64)), one(counts[order].astype(np.int64)), one(points[order]), one(flat)],
                    names=["cell", "sub", "dim", "ids", "counts", "points", "nodes"])


INDEX_SCHEMA = "cell int, sub int, dim int, ids binary, counts binary, points binary, nodes binary"


def _searched(index: DataFrame, asked: DataFrame, k: int, factor: float) -> DataFrame:
    """``asked``: cell, query_id, qv, bound. Neighbours found in the cells'
    shards: query_id, vec_id, score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(i)[r] for i, n in enumerate(b.schema.names)}
                buf = lambda n, t: np.frombuffer(row[n].as_buffer(), dtype=t)
                flat = buf("nodes", np.float64).reshape(-1, 7)
                nodes = {(int(x[0]), int(x[1])): (int(x[2]), *x[3:]) for x in flat.tolist()}
                dim = row["dim"].as_py()
                tree = Tree(buf("ids", np.int64), buf("points", np.float64).reshape(-1, dim), buf("counts", np.int64), nodes)
                qs = row["qs"].values
                q = _matrix(qs.field("qv"))
                qid = qs.field("query_id").to_numpy(zero_copy_only=False)
                d, who = tree.search(qid, q, qs.field("bound").to_numpy(zero_copy_only=False), k, factor)
                hit = np.isfinite(d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qid, hit.sum(axis=1))), pa.array(who[hit]), pa.array(d[hit])],
                    names=["query_id", "vec_id", "score"])
    # blocks of queries, so that no shard meets an unbounded list
    n = asked.groupBy(F.col("cell").alias("n_cell")).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("long").alias("nb"))
    blocks = asked.join(sized(staged(n, "vp-blocks")), F.col("cell") == F.col("n_cell")).groupBy(
        "cell", F.pmod(F.xxhash64("query_id"), F.col("nb")).alias("qb")).agg(
        F.collect_list(F.struct("query_id", "qv", "bound")).alias("qs"))
    # a shard and a block of queries are one job; jobs are dealt out evenly
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    jobs = staged(blocks, "vp-jobs").join(index, "cell").drop("qb", "sub").repartition(tasks)
    return jobs.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
            k: int = K_NEAREST, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score. ``queries`` has the columns of
    ``vectors``; a query's own id is no candidate."""
    if k > K_NEAREST:
        raise ValueError(f"the index keeps ids for up to {K_NEAREST} neighbours")

    def valid(df: DataFrame) -> DataFrame:
        v = df[vec_col].cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
        rows = df.select(df[id_col].cast("long").alias("id"), v.alias("vec")).filter(F.col("id").isNotNull() & fine)
        return rows.groupBy("id").agg(F.min(F.struct(F.xxhash64("vec").alias("h"), "vec")).alias("one")).select("id", "one.vec")

    rows = staged(valid(vectors), "vp-rows")
    n = rows.count()
    n_pivots = min(MAX_PIVOTS, max(1, -(-n // shard_rows)))
    # a bounded sample: the smallest hashes, distinct vectors
    pivots = rows.select("vec").distinct().orderBy(F.xxhash64("vec")).limit(n_pivots).toArrow()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sets: dict[int, list] = {}
    for c, v in enumerate(pivots.column("vec").to_pylist()):
        sets.setdefault(len(v), []).append((c, v))
    cells = {dim: (np.array([c for c, _ in s]), np.array([v for _, v in s])) for dim, s in sets.items()}

    def to_pivots(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
        """The nearest pivot's cell and distance, with ``every`` those of all
        pivots; a dimension without a pivot has a cell of its own (negative)."""
        for b in batches:
            lens = pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(lens).tolist():
                part = b.filter(pa.array(lens == dim))
                cell, d = np.array([-dim]), np.zeros((part.num_rows, 1))
                if dim in cells:
                    cell, p = cells[dim]
                    d = distances(_matrix(part.column(1)), p)
                cols = [pa.array(cell[d.argmin(axis=1)].astype(np.int32)), pa.array(d.min(axis=1))]
                if every:
                    at = pa.array(np.arange(0, d.size + 1, len(cell), dtype=np.int32))
                    cols += [pa.ListArray.from_arrays(at, pa.array(np.tile(cell, len(d)).astype(np.int32))),
                             pa.ListArray.from_arrays(at, pa.array(d.ravel()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=["id", "vec", "cell", "d", "cells", "ds"][:2 + len(cols)])
    schema = "id long, vec array<double>, cell int, d double"
    placed = staged(rows.mapInArrow(lambda b: to_pivots(b, False), schema), "vp-placed")
    stats = staged(placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("r0"), F.max("d").alias("r1")), "vp-cells")
    subs = stats.select(F.col("cell").alias("s_cell"), F.ceil(F.col("n") / shard_rows).cast("long").alias("subs"))
    shards = placed.join(sized(subs), F.col("cell") == F.col("s_cell")).select(
        "cell", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int").alias("sub"), "id", "vec")
    index = staged(shards.groupBy("cell", "sub").applyInArrow(_build_shard, INDEX_SCHEMA), "vp-index")

    asked = staged(valid(queries).mapInArrow(lambda b: to_pivots(b, True), schema + ", cells array<int>, ds array<double>"),
                   "vp-queries")
    home = _searched(index, asked.select("cell", F.col("id").alias("query_id"), F.col("vec").alias("qv"),
                                         F.lit(float("inf")).alias("bound")), k, factor)
    home = staged(home, "vp-home")
    # the k-th score of what a query found at home; each task keeps k a query before the exchange
    nth = Window.partitionBy("query_id").orderBy("score", "vec_id")
    bound = home.withColumn("r", F.row_number().over(nth)).filter(F.col("r") <= k).filter(F.col("r") == k).select(
        "query_id", F.col("score").alias("bound"))
    far = asked.select(F.col("id").alias("query_id"), F.col("vec").alias("qv"), F.col("cell").alias("own"),
                       F.explode(F.arrays_zip("cells", "ds")).alias("p"))
    far = far.select("query_id", "qv", "own", F.col("p.cells").alias("cell"), F.col("p.ds").alias("d")).filter("cell <> own")
    far = far.join(sized(stats), "cell").join(bound, "query_id", "left")
    bound_col = F.coalesce("bound", F.lit(float("inf")))
    low = F.greatest(F.col("d") - F.col("r1"), F.col("r0") - F.col("d"), F.lit(0.0))
    far = far.filter(low * factor <= bound_col * (1 + 1e-9) + 1e-12).select("cell", "query_id", "qv", bound_col.alias("bound"))
    more = _searched(index, staged(far, "vp-far"), k, factor)
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return home.union(more).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_vantage_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))
