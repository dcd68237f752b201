"""Exact top-k by integer inner product: a Voronoi kNN join.

Equal vectors are one point that carries its smallest ids, so a very common vector costs no more than a rare one.
About sqrt(n) pivots cut points and queries into cells. Two passes follow. The first solves each query against a block of
the cell with the highest inner product to its pivot, which proves a floor: a score that its k-th best reaches. The
second bounds each query against each cell from the cell's summary (points, radius, longest vector), and a cell whose
bound lies below the floor is not read for that query. Queries of neighbouring cells form groups of about BLOCK; a data
cell is replicated only to groups of which some query needs it. Within a group, a query meets only the cells that it
needs. Blocks of bounded size are solved locally by matrix products and merged by a top-k that is cut before its shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidegraph.llm.common import materialise, table

SCALE = 64
K = 20
QUERY_EVERY = 20
#: Points or queries of a block, about.
BLOCK = 8192
#: Most pivots for each number of components, and so most summaries that the driver and every worker hold; more points
#: make larger cells, which are cut into blocks.
MAX_PIVOTS = 2048
LIMIT = 1 << 62


def quantise(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components floor(scale * x) as 64-bit integers in bytes. Rows without id, or with a null vector or a null or non-finite component, take no part."""

    def run(batches):
        for batch in batches:
            ids, col = batch.column("vec_id").cast(pa.int64()), batch.column("embedding")
            out_id, out_v = [], []
            for k, (i, row) in enumerate(zip(ids.to_pylist(), col, strict=True)):
                if i is None or not row.is_valid or row.values.null_count:
                    continue
                x = np.floor(row.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if not np.isfinite(x).all():
                    continue
                out_id.append(i)
                out_v.append(np.clip(x, -LIMIT, LIMIT).astype("<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(out_id, pa.int64()), "v": pa.array(out_v, pa.binary())})

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, v binary")


def matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype="<i8").reshape(len(values), -1)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floating point where no sum can round, else in integers of any size, held at the ends of a long."""
    peak = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if peak < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if peak < 1 << 62:
        return q @ x.T
    big = q.astype(object) @ x.astype(object).T
    return np.vectorize(lambda s: max(-LIMIT, min(LIMIT, int(s))), otypes=[np.int64])(big)


def nearest(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and distance of each vector."""
    f, p = v.astype(np.float64), pivots.astype(np.float64)
    cell = ((p**2).sum(1)[None, :] - 2 * f @ p.T).argmin(1)
    return cell, np.sqrt(((f - p[cell]) ** 2).sum(1))


def by_dim(values: list[bytes], dims: np.ndarray):
    """(number of components, places, matrix) of vectors."""
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield d, at, matrix([values[k] for k in at.tolist()]).reshape(len(at), d)


def in_cells(points: DataFrame, pivots: dict[int, np.ndarray], extra: str) -> DataFrame:
    """Add cell, distance and length; `extra` is the schema of the columns besides v. pivots: by number of components."""
    sent = points.sparkSession.sparkContext.broadcast(pivots)
    names = [c.strip().split(" ")[0] for c in extra.split(",")]

    def run(batches):
        for batch in batches:
            values = batch.column("v").to_pylist()
            dims = np.array([len(v) // 8 for v in values], dtype=np.int64)
            cell, far, size = np.zeros(len(values), np.int64), np.zeros(len(values)), np.zeros(len(values))
            for d, at, v in by_dim(values, dims):
                cell[at], far[at] = nearest(v, sent.value[d])
                size[at] = np.linalg.norm(v.astype(np.float64), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [batch.column("v"), *map(pa.array, (dims, cell, far, size))], names=[*names, "v", "dim", "cell", "far", "size"])

    return points.select(*names, "v").mapInArrow(run, f"{extra}, v binary, dim long, cell long, far double, size double")


def choose_pivots(points: DataFrame, most: int = MAX_PIVOTS) -> dict[int, np.ndarray]:
    """About sqrt(n) of the n vectors, those with the smallest hashes, by number of components; at most `most`."""
    out: dict[int, np.ndarray] = {}
    dims = points.groupBy((F.octet_length("v") / 8).cast("long").alias("d")).agg(F.count("*").alias("n")).collect()
    for d, rows in dims:
        n = int(min(most, max(1, math.isqrt(rows))))
        got = points.where(F.octet_length("v") == 8 * d).orderBy(F.xxhash64("v"), "v").limit(n).collect()
        out[d] = np.array([np.frombuffer(bytes(r["v"]), dtype="<i8") for r in got], dtype=np.int64).reshape(len(got), d)
    return out


class Cells:
    """Summaries of the data cells of one number of components: pivot, points, radius and longest vector of each."""

    def __init__(self, pivots: np.ndarray, rows: list):
        rows = sorted(rows, key=lambda r: r[0])
        self.cell = np.array([r[0] for r in rows], dtype=np.int64)
        self.points, self.radius, self.longest = (np.array([r[k] for r in rows], dtype=np.float64) for k in (1, 2, 3))
        self.pivot = pivots.astype(np.float64)[self.cell]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """What no point of a cell exceeds, for each query and cell; rounded up."""
        f = q.astype(np.float64)
        mid, size = f @ self.pivot.T, np.linalg.norm(f, axis=1)[:, None]
        most = np.minimum(mid + size * self.radius, size * self.longest)
        return most + 1e-9 * (np.abs(mid) + size * (self.radius + self.longest)) + 1e-6

    def seeds(self, q: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The cell with the highest inner product to its pivot among those with at least `need` points; else the largest cell."""
        mid = q.astype(np.float64) @ self.pivot.T
        mid[self.points[None, :] < need[:, None]] = -np.inf
        best = np.where(np.isfinite(mid).any(1), mid.argmax(1), self.points.argmax())
        return self.cell[best]


def add_seeds(queries: DataFrame, cells) -> DataFrame:
    def run(batches):
        for batch in batches:
            need, b = batch.column("need").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for d, at, q in by_dim(batch.column("v").to_pylist(), batch.column("dim").to_numpy()):
                b[at] = cells.value[d].seeds(q, need[at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(b)], names=[*batch.schema.names, "b"])

    return queries.mapInArrow(run, T.StructType([*queries.schema.fields, T.StructField("b", T.LongType())]))


def needed_cells(queries: DataFrame, cells) -> DataFrame:
    """(dim, group, b, asked): the data cells that some query of a group cannot rule out, and how many of its queries cannot."""

    def run(batches):
        for batch in batches:
            group, floor, out = batch.column("g").to_numpy(), batch.column("floor").to_numpy(zero_copy_only=False), []
            for d, at, q in by_dim(batch.column("v").to_pylist(), batch.column("dim").to_numpy()):
                open_ = cells.value[d].bounds(q) >= floor[at][:, None]
                for g in np.unique(group[at]).tolist():
                    n = open_[group[at] == g].sum(0)
                    out += [(d, g, int(cells.value[d].cell[k]), int(n[k])) for k in np.flatnonzero(n).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["dim", "g", "b", "asked"])

    return queries.select("dim", "g", "v", "floor").mapInArrow(run, "dim long, g long, b long, asked long").groupBy("dim", "g", "b").agg(F.sum("asked").alias("asked"))


def groups_of(cells: list, block: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(dim, query cell) to (first group, groups): small cells share a group, and a large one is dealt over several.

    cells: (dim, cell, queries, pivot); neighbours stand together, as cells are ordered by their pivot's nearest of a few.
    """
    out, at, held = {}, 0, 0
    for dim in sorted({c[0] for c in cells}):
        mine = [c for c in cells if c[0] == dim]
        few = np.stack([c[3] for c in mine[: max(1, math.isqrt(len(mine)))]]).astype(np.float64)
        near, _ = nearest(np.stack([c[3] for c in mine]), few)
        at, held = at + (held > 0), 0
        for k in np.argsort(near, kind="stable").tolist():
            _, cell, n, _ = mine[k]
            if held and held + n > block:
                at, held = at + 1, 0
            parts = -(-n // block)
            out[dim, cell] = (at, parts)
            at, held = (at + parts, 0) if parts > 1 else (at, held + n)
    return out


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with the other rows, ties to the smaller id.

    Queries are the rows whose vec_id is divisible by `every`. Null ids, null vectors and vectors with a null or
    non-finite component take no part. Vectors are compared with those of as many components. Rows that repeat an id
    and its vector count once; a query is never its own neighbour, by id. Fewer candidates than k are all returned;
    an empty table gives no rows. Scores are exact; one past a long is held at its end. Other columns are ignored.
    """
    return search(vectors, k, every, scale)[0]


def search(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, scale: int = SCALE) -> tuple[DataFrame, DataFrame]:
    """What `top_k` returns, and (dim, g, b, asked, queries, points): the pairs of query groups and data cells that are solved."""
    spark = vectors.sparkSession
    rows = materialise(quantise(vectors, scale), "vectors")
    few = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    points = materialise(few.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "points")
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    # q names a query vector; one of an id with several vectors stands alone, as all of them are left out for it
    held = asked.groupBy("vec_id").agg(F.count("*").alias("m"))
    own = F.when(F.col("m") > 1, F.col("vec_id"))
    asks = asked.join(held, "vec_id").withColumn("own", own).withColumn("q", F.when(F.col("m") > 1, F.xxhash64("v", "vec_id")).otherwise(F.xxhash64("v")))
    asks = materialise(asks.withColumn("need", F.col("m") + k), "asks")
    pivots = choose_pivots(points)
    data = materialise(in_cells(points, pivots, "ids array<long>"), "data")
    ask_points = asks.select("q", "v", "own", "need").distinct()
    query = materialise(in_cells(ask_points, pivots, "q long, own long, need long"), "queries")
    summary: dict[int, list] = {}
    for dim, *row in data.groupBy("dim", "cell").agg(F.count("*"), F.max("far"), F.max("size")).collect():  # at most MAX_PIVOTS a number of components
        summary.setdefault(dim, []).append(row)
    cells = spark.sparkContext.broadcast({d: Cells(pivots[d], r) for d, r in summary.items()})
    asked_cells = [(d, c, n, pivots[d][c]) for d, c, n in query.groupBy("dim", "cell").agg(F.count("*")).orderBy("dim", "cell").collect()]
    groups = groups_of(asked_cells, BLOCK)
    sizes = [(d, c, n, -(-n // BLOCK)) for d, rs in summary.items() for c, n, *_ in rs]
    cut = F.broadcast(spark.createDataFrame(sizes, "dim long, b long, points long, dn int"))  # a row a data cell
    deal = F.broadcast(spark.createDataFrame([(d, c, g, n) for (d, c), (g, n) in groups.items()], "dim long, cell long, first long, gn int"))  # a row a query cell
    part = lambda n, by: F.pmod(F.xxhash64(by, F.lit("part")), F.col(n)).cast("int")
    dealt = data.withColumnRenamed("cell", "b").join(cut, ["dim", "b"]).withColumn("j", part("dn", "v")).select("dim", "b", "j", "v", "ids")
    query = query.join(deal, ["dim", "cell"]).withColumn("g", F.col("first") + part("gn", "q")).select("dim", "g", "v", "q", "own", "need")

    def solve(x: pa.Table, q: pa.Table, floors: bool) -> pa.Table:
        """The best of each query in a block of a cell; or the floor that the block proves."""
        names = ["q", "floor"] if floors else ["q", "vec_id", "score"]
        got: list = []
        if x.num_rows and q.num_rows:
            d, b = x.column("dim")[0].as_py(), x.column("b")[0].as_py()
            queries, keep = matrix(q.column("v").to_pylist()).reshape(q.num_rows, d), np.arange(q.num_rows)
            if not floors:
                c = cells.value[d]
                keep = np.flatnonzero(c.bounds(queries)[:, np.searchsorted(c.cell, b)] >= q.column("floor").to_numpy())
            ids = x.column("ids").combine_chunks()
            ids = ids if isinstance(ids, pa.ListArray) else ids.chunk(0)
            block = Block(matrix(x.column("v").to_pylist()).reshape(x.num_rows, d), pc.list_flatten(ids).to_numpy(zero_copy_only=False), pc.list_parent_indices(ids).to_numpy(zero_copy_only=False))
            label, own, need = (q.column(n).to_pylist() for n in ("q", "own", "need"))
            for at in range(0, len(keep), 256):
                some = keep[at : at + 256]
                for row, j in zip(scores(queries[some], block.v), some.tolist(), strict=True):
                    if floors:
                        if (found := block.floor(row, own[j], need[j])) is not None:
                            got.append((np.array([label[j]]), np.array([found])))
                    else:
                        vid, sc = block.best(row, own[j], k)
                        got.append((np.full(len(vid), label[j]), vid, sc))
        columns = [np.concatenate(z) for z in zip(*got, strict=True)] if got else [[] for _ in names]
        return pa.table({n: pa.array(z, pa.float64() if n == "floor" else pa.int64()) for n, z in zip(names, columns, strict=True)})

    # first pass: any block of a good cell proves a floor
    first = dealt.where("j = 0").select("dim", "b", "v", "ids")
    seeded = add_seeds(query, cells)
    n_seeds = F.broadcast(materialise(seeded.groupBy("dim", "b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("sn")), "seeds"))  # a row a data cell at most
    lots = seeded.join(n_seeds, ["dim", "b"]).withColumn("i", part("sn", "q")).select("dim", "b", "i", "v", "q", "own", "need")
    held_out = first.join(n_seeds, ["dim", "b"]).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("sn") - 1))).select("dim", "b", "i", "v", "ids")
    key = ["dim", "b", "i"]
    floors = held_out.groupBy(*key).cogroup(lots.groupBy(*key)).applyInArrow(lambda x, q: solve(x, q, True), "q long, floor double")
    query = materialise(query.join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "floors")
    # second pass: the cells that the floors leave
    plan = materialise(needed_cells(query, cells).join(cut, ["dim", "b"]).join(query.groupBy("dim", "g").agg(F.count("*").alias("queries")), ["dim", "g"]), "pairs")
    pairs = plan.select("dim", "g", "b", "dn")
    left = dealt.join(pairs.drop("dn"), ["dim", "b"]).select("dim", "g", "b", "j", "v", "ids")
    right = query.join(pairs, ["dim", "g"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("dn") - 1))).select("dim", "g", "b", "j", "v", "q", "own", "need", "floor")
    key = ["dim", "g", "b", "j"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda x, q: solve(x, q, False), "q long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    out = asks.select(F.col("vec_id").alias("query_id"), "q").join(lists, "q")
    mine = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(mine).alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"), plan


class Block:
    """Points of a cell: vectors, and their ids side by side, in ascending order within a point."""

    def __init__(self, v: np.ndarray, flat: np.ndarray, point: np.ndarray):
        self.v, self.flat = v, flat
        self.begin, self.size = np.searchsorted(point, np.arange(len(v))), np.bincount(point, minlength=len(v))
        self.first = flat[self.begin]

    def others(self, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(points with an id other than `own`, the smallest such id of every point)."""
        if own is None:
            return np.arange(len(self.v)), self.first
        mine = self.first == own
        least = np.where(mine & (self.size > 1), self.flat[np.minimum(self.begin + 1, len(self.flat) - 1)], self.first)
        return np.flatnonzero(~mine | (self.size > 1)), least

    def floor(self, row: np.ndarray, own: int | None, need: int) -> float | None:
        """The need-th best score; none where there are fewer, or where it is held at the end of a long and so proves nothing."""
        open_, _ = self.others(own)
        found = int(np.partition(row[open_], len(open_) - need)[len(open_) - need]) if len(open_) >= need else -LIMIT
        return float(found) if found > -LIMIT else None

    def best(self, row: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k + 1 ids by (score, id)."""
        keep, least = self.others(own)
        if len(keep) > k + 1:  # every point past the best k + 1 by (score, its smallest id) is beaten by as many ids
            edge = np.partition(row[keep], len(keep) - k - 1)[len(keep) - k - 1]
            at_least = keep[row[keep] >= edge]
            keep = at_least[np.lexsort((least[at_least], -row[at_least]))[: k + 1]]
        where = np.concatenate([np.arange(self.begin[p], self.begin[p] + self.size[p]) for p in keep.tolist()] or [np.zeros(0, np.int64)])
        sc, vid = np.repeat(row[keep], self.size[keep]), self.flat[where]
        if own is not None:
            sc, vid = sc[vid != own], vid[vid != own]
        best = np.lexsort((vid, -sc))[: k + 1]
        return vid[best], sc[best]


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM ok q JOIN ok x ON q.vec_id % {QUERY_EVERY} = 0 AND x.vec_id <> q.vec_id AND len(q.v) = len(x.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
