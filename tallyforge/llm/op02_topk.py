"""Operator 2: exact top-k inner-product search with ball trees."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.session import written

K = 10
#: Vectors of a shard, at most about, and of a leaf of its tree, at most.
SHARD, LEAF = 4096, 128
#: Queries that pass over the shards together.
BLOCK = 65_536
#: Vectors, by hash of their id, that give each query a first kth score; of those, the most that space is divided by.
SAMPLE, PIVOTS = 4096, 1024
#: Scores are rounded to so many places, so that equal vectors tie.
PLACES, SLACK = 6, 2e-6


def build(x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Order of the rows of x in the tree, and its nodes in level order: rows lo:hi, parent, centre, radius, leaf."""
    order = np.arange(len(x))
    lo, hi, parent, leaf = [0], [len(x)], [-1], []
    i = 0
    while i < len(lo):
        a, b = lo[i], hi[i]
        leaf.append(b - a <= LEAF)
        if not leaf[-1]:
            rows = x[order[a:b]]
            far = rows[np.argmax(((rows - rows.mean(0)) ** 2).sum(1))]
            other = rows[np.argmax(((rows - far) ** 2).sum(1))]
            order[a:b] = order[a:b][np.argsort(rows @ (other - far), kind="stable")]
            middle = (a + b) // 2
            lo += [a, middle]
            hi += [middle, b]
            parent += [i, i]
        i += 1
    centre = np.stack([x[order[a:b]].mean(0) for a, b in zip(lo, hi)])
    radius = np.array([np.sqrt(((x[order[a:b]] - c) ** 2).sum(1).max()) for a, b, c in zip(lo, hi, centre)])
    return order, {"lo": np.array(lo), "hi": np.array(hi), "parent": np.array(parent), "leaf": np.array(leaf), "centre": centre, "radius": radius}


class Best:
    """The k best (score, id) of each query so far; equal scores are ordered by id."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.q, self.score, self.id, self.products = k, np.zeros(0, np.int64), np.zeros(0), None, 0
        self.kth = np.full(n, -np.inf) if floor is None else floor.copy()

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if self.id is not None:
            q, score, ids = np.concatenate([self.q, q]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        keep = place < self.k
        self.q, self.score, self.id = q[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.kth[q[full]] = np.maximum(self.kth[q[full]], score[full])


def search(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, tree: dict[str, np.ndarray], best: Best) -> None:
    """Adds the rows of x that can be among the k best of each query, but for the one of its own id.

    Branch and bound: a node's inner-product upper bound is query . centre + |query| * radius. Descending the
    tree level by level, a branch below the query's kth score is cut; each query then visits the leaves that
    remain in falling order of their bounds, until a bound falls below the kth score, which rises meanwhile.
    """
    lengths = np.linalg.norm(queries, axis=1)
    may = np.flatnonzero(queries @ tree["centre"][0] + lengths * tree["radius"][0] + SLACK >= best.kth)
    if not len(may):
        return
    bound = np.full((len(queries), len(tree["leaf"])), -np.inf)
    bound[may] = queries[may] @ tree["centre"].T + lengths[may, None] * tree["radius"] + SLACK
    parent, leaves = tree["parent"], np.flatnonzero(tree["leaf"])
    for node in range(1, len(parent)):
        np.minimum(bound[:, node], bound[:, parent[node]], out=bound[:, node])
    bound = bound[:, leaves]
    order = np.argsort(-bound, axis=1, kind="stable")
    active = may
    for turn in range(len(leaves)):
        at = order[active, turn]
        open_ = bound[active, at] >= best.kth[active]
        active, at = active[open_], at[open_]
        if not len(active):
            return
        found = []
        by = np.argsort(at, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
            a, b = tree["lo"][leaves[at[group[0]]]], tree["hi"][leaves[at[group[0]]]]
            qs = active[group]
            score = np.round(queries[qs] @ x[a:b].T, PLACES) + 0.0
            best.products += score.size
            r, c = np.nonzero((score >= best.kth[qs][:, None]) & (ids[a:b][None, :] != query_ids[qs][:, None]))
            found.append((qs[r], score[r, c], ids[a:b][c]))
        best.add(*(np.concatenate(part) for part in zip(*found)))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v), one vector for each id: the smallest of those without a null, NaN or infinite component."""
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return given.where("id is not null and size(v) > 0 and not exists(v, e -> e is null or isnan(e) or abs(e) = double('infinity'))").groupBy("id").agg(F.min("v").alias("v"))


def by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the rows (id, v) of a table, by the length of v."""
    if not table.num_rows:
        return {}
    v = table.column("v").combine_chunks()
    off, flat = np.asarray(v.offsets), np.asarray(v.values, np.float64)
    ids = np.empty(len(v), object)
    ids[:] = table.column("id").to_pylist()
    sizes = np.diff(off)
    return {int(n): (ids[sizes == n], flat[off[:-1][sizes == n][:, None] + np.arange(n)]) for n in np.unique(sizes)}


def top_k(vectors: DataFrame, k: int = K, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The k largest inner products of every query with the vectors of other ids: (vec_id, rank, neighbor_id, score), exact.

    queries: rows of the same columns; None: all vectors. Vectors go to the nearest of at most PIVOTS points, and
    those of one point, if many, to several shards by the hash of their id, so that a shard is compact where the
    data are and none holds more than about shard vectors. Each shard has a ball tree. Queries pass over all
    shards in blocks of BLOCK, which are broadcast; the kth score among SAMPLE vectors is each query's first
    bound. A task searches its shards one after the other with the kth scores found so far, and only what
    reaches them is merged. A shard whose ball can't reach a query's kth score costs one bound.

    Scores are rounded to 6 places; equal ones are ordered by id. A null id or vector, an empty vector or one
    with a null, NaN or infinite component has no row. Rows of one id are one vector, the smallest. Vectors of
    different length don't meet. With fewer than k others there are fewer rows. An empty table gives none. Other
    columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    given = written(usable(vectors, id_col, vector_col), "topk-vectors")
    asked = given if queries is None else written(usable(queries, id_col, vector_col), "topk-queries")
    kind = given.schema["id"].dataType.simpleString()
    sample = by_length(given.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow())
    wanted = max(1, min(PIVOTS, -(-given.count() // shard)))
    pivots = spark.sparkContext.broadcast({n: x[:wanted] for n, (_, x) in sample.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            sizes, at = np.diff(np.asarray(v.offsets)), np.zeros(batch.num_rows, np.int32)
            flat = np.asarray(v.flatten(), np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                points = pivots.value.get(int(n))
                if points is not None:
                    x = flat[starts[rows][:, None] + np.arange(n)]
                    at[rows] = np.argmin((points**2).sum(1) - 2 * x @ points.T, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), v, pa.array(at), pa.array(sizes.astype(np.int32))], ["id", "v", "point", "dim"])

    placed = written(given.mapInArrow(place, f"id {kind}, v array<double>, point int, dim int"), "topk-placed")
    parts = placed.groupBy("dim", "point").agg(F.ceil(F.count("*") / F.lit(shard)).alias("parts"))
    keyed = placed.join(parts, ["dim", "point"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks()
        x = np.array(table.column("v").combine_chunks().flatten(), np.float64).reshape(len(ids), -1)
        order, tree = build(x)
        ids, x = ids.take(pa.array(order)), x[order]
        return pa.table({"dim": pa.array([x.shape[1]], pa.int32()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "x": pa.array([pickle.dumps(x)], pa.binary()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    met = []
    try:
        trees = written(keyed.groupBy("dim", "point", "part").applyInArrow(grow, f"dim int, ids array<{kind}>, x binary, tree binary"), "topk-trees")
        spark.conf.set(batch, "4")  # a row holds a shard
        blocks = -(-asked.count() // block)
        cut = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, blocks)))) if blocks > 1 else asked.withColumn("block", F.lit(0))
        for i in range(blocks):
            turn = by_length(cut.where(F.col("block") == i).select("id", "v").toArrow())
            floors = {}
            for n, (ids, q) in turn.items():
                best = Best(len(q), k)
                if n in sample:
                    for a in range(0, len(q), 4096):
                        score = np.round(q[a : a + 4096] @ sample[n][1].T, PLACES) + 0.0
                        score[ids[a : a + 4096, None] == sample[n][0][None, :]] = -np.inf
                        if score.shape[1] >= k:
                            best.kth[a : a + 4096] = np.partition(score, -k, axis=1)[:, -k]
                floors[n] = best.kth
            shared = spark.sparkContext.broadcast((turn, floors))

            def meet(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                turn, floors = shared.value
                held = {n: Best(len(q), k, floors[n]) for n, (_, q) in turn.items()}
                for batch in batches:
                    id_type = batch.schema.field("ids").type.value_type
                    for r in range(batch.num_rows):
                        n = batch.column("dim")[r].as_py()
                        if n in turn:
                            ids, q = turn[n]
                            others = np.array(batch.column("ids")[r].values.to_pylist(), object)
                            search(q, ids, pickle.loads(batch.column("x")[r].as_py()), others, pickle.loads(batch.column("tree")[r].as_py()), held[n])
                for n, best in held.items():
                    if best.id is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(turn[n][0][best.q].tolist(), id_type), pa.array(best.id.tolist(), id_type), pa.array(best.score)], ["vec_id", "neighbor_id", "score"])

            met.append(written(trees.mapInArrow(meet, f"vec_id {kind}, neighbor_id {kind}, score double"), "topk-met"))
    finally:
        spark.conf.set(batch, before)
    every = met[0] if met else spark.createDataFrame([], f"vec_id {kind}, neighbor_id {kind}, score double")
    for more in met[1:]:
        every = every.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbor_id"))
    return every.select("vec_id", rank.alias("rank"), "neighbor_id", "score").where(F.col("rank") <= k)


#: The queries of the registered search: the vectors whose id is divisible by 100, against all.
ASKED = "vec_id % 100 = 0"
ORACLE = f"""with v as (select vec_id, min(embedding::double[]) e from embeddings where vec_id is not null and len(embedding) > 0 group by 1),
pairs as (select a.vec_id, b.vec_id neighbor_id, round(list_inner_product(a.e, b.e), {PLACES}) score from (from v where {ASKED}) a join v b on a.vec_id <> b.vec_id),
ranked as (select vec_id, row_number() over (partition by vec_id order by score desc, neighbor_id)::int rank, neighbor_id, score from pairs)
select * from ranked where rank <= {K}"""
