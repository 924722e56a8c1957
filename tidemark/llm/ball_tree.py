"""Exact maximum-inner-product search: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards of bounded size, near ones together: planes that halve a bounded sample cut the
space into cells, and large cells are split further. Queries stand in blocks of bounded size by the same cells.
A node's ball (centre c, radius r) bounds the inner product of any vector in it with q by q.c + |q| r. A
block first searches the shard of its own cell; the k-th scores there are its floor. The root balls of all
shards, a few numbers each, then tell which queries can find more in which shard: only those travel,
and shards stay where they are. Within a task, the k-th scores reached for a block serve its next shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: No score: its negative is a 64-bit integer too, which sorting needs.
NONE = np.iinfo(np.int64).min + 1
_SHARD = "dim int, shard long, ids binary, rows binary, vectors binary, lo binary, hi binary, left binary, right binary, centres binary, radii binary"
_BLOCK = "dim int, block long, shard long, q_ids binary, q_rows binary, q_vectors binary"
_PAIR = "dim int, shard long, block long, q_ids binary, q_rows binary, q_vectors binary, floor binary, place binary, size int"
_HIT = "row long, query_id long, vec_id long, score long"


def build_tree(vectors: np.ndarray, leaf: int = 256) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the rows and the nodes over it: lo, hi (row range), left, right (-1: leaf), centre, radius.

    Parents come before their children. A node is halved at the median of the projection on the line
    between two far rows, so the depth is logarithmic whatever the data, equal rows included.
    """
    order, nodes, todo = np.arange(len(vectors)), [], [(0, len(vectors), -1, 0)]
    points = vectors.astype(np.float64)
    while todo:
        lo, hi, parent, side = todo.pop()
        own = points[order[lo:hi]]
        centre = own.mean(0)
        away = np.sqrt(((own - centre) ** 2).sum(1))
        me = len(nodes)
        nodes.append([lo, hi, -1, -1, centre, away.max()])
        if parent >= 0:
            nodes[parent][2 + side] = me
        if hi - lo > leaf:
            far = own[away.argmax()]
            line = far - own[((own - far) ** 2).sum(1).argmax()]
            half = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(own @ line, half)]
            todo += [(lo + half, hi, me, 1), (lo, lo + half, me, 0)]
    names = ("lo", "hi", "left", "right")
    return order, {n: np.array([x[k] for x in nodes], np.int64) for k, n in enumerate(names)} | {
        "centres": np.array([x[4] for x in nodes]).reshape(len(nodes), points.shape[1]), "radii": np.array([x[5] for x in nodes]),
    }


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point only where that is exact too."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The k best (score, vec_id) of each query so far, ties to the smaller vec_id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.scores = np.full((queries, k), NONE)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.floor = np.full(queries, NONE) if floor is None else floor

    def least(self) -> np.ndarray:
        """What a score must reach to matter: the k-th so far, here or as another shard knows it."""
        return np.maximum(self.scores[:, -1], self.floor)

    def take(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        live = (scores >= self.least()[rows, None]).any(1)
        rows, scores = rows[live], scores[live]
        if len(rows):
            both = np.concatenate([self.scores[rows], scores], 1)
            names = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], 1)
            order = np.lexsort((names, -both), axis=1)[:, : self.ids.shape[1]]
            self.scores[rows], self.ids[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)


def search(tree: dict[str, np.ndarray], vectors: np.ndarray, ids: np.ndarray, rows_of: np.ndarray, queries: np.ndarray, own: np.ndarray, best: Best) -> None:
    """Branch and bound for all queries at once; ``own`` are the rows that the queries are themselves. Level by level, nodes that no query can use are cut; each
    query then visits the leaves left to it from the highest bound down, until none reaches its k-th score."""
    norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    real = queries.astype(np.float64)
    level = np.array([0])
    caps = real @ tree["centres"][level].T + norms[:, None] * tree["radii"][level]
    leaves, bounds = [], []
    slack = 1e-9 * (norms.max(initial=0) * (np.abs(tree["centres"]).sum(1).max(initial=0) + tree["radii"].max(initial=0)) + 1)
    while len(level):
        useful = (caps + slack >= best.least()[:, None]).any(0)
        level, caps = level[useful], caps[:, useful]
        end = tree["left"][level] < 0
        leaves.append(level[end])
        bounds.append(caps[:, end])
        up = np.repeat(caps[:, ~end], 2, axis=1)
        level = np.stack([tree["left"][level[~end]], tree["right"][level[~end]]], 1).reshape(-1)
        caps = np.minimum(up, real @ tree["centres"][level].T + norms[:, None] * tree["radii"][level])
    leaves, bounds = np.concatenate(leaves), np.concatenate(bounds, 1) + slack
    order = np.argsort(-bounds, axis=1)
    for turn in range(len(leaves)):
        at = order[:, turn]
        active = np.flatnonzero(np.take_along_axis(bounds, at[:, None], 1)[:, 0] >= best.least())
        if not len(active):
            break
        for leaf in np.unique(at[active]):
            rows = active[at[active] == leaf]
            lo, hi = tree["lo"][leaves[leaf]], tree["hi"][leaves[leaf]]
            scores = _products(queries[rows], vectors[lo:hi])
            scores[own[rows, None] == rows_of[None, lo:hi]] = NONE
            best.take(rows, scores, ids[lo:hi])


def _integers(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, dim, v): components as floor(1024 x); rows with null or non-finite parts are left out."""
    whole = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")),
    )
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(whole)
    return usable.select(
        F.monotonically_increasing_id().alias("row"), "vec_id", F.size("embedding").alias("dim"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024).cast("long")).alias("v"),
    )


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy()
    return values.reshape(rows, len(values) // rows if rows else 0)


# ---- cells


def cut_planes(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes (direction, threshold, what lies below and above it) that halve the points until ``leaf`` or fewer are
    together. What lies there is another plane, or cell c as -1 - c."""
    planes, cells, todo = [], 0, [(points.astype(np.float64), -1, 0)]
    while todo:
        own, parent, side = todo.pop()
        below = None
        if len(own) > leaf:
            far = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
            line = far - own[((own - far) ** 2).sum(1).argmax()]
            reach = own @ line
            cut = np.median(reach)
            below = reach < cut
        if below is None or not below.any():
            me, cells = -1 - cells, cells + 1
        else:
            me = len(planes)
            planes.append([line, cut, [0, 0]])
            todo += [(own[~below], me, 1), (own[below], me, 0)]
        if parent >= 0:
            planes[parent][2][side] = me
    return np.array([x[0] for x in planes]).reshape(len(planes), points.shape[1]), np.array([x[1] for x in planes]), np.array([x[2] for x in planes], np.int64).reshape(-1, 2)


def cell_of(points: np.ndarray, planes: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> np.ndarray:
    if planes is None or not len(planes[1]):
        return np.zeros(len(points), np.int64)
    lines, cuts, onward = planes
    at, points = np.zeros(len(points), np.int64), points.astype(np.float64)
    while (live := np.flatnonzero(at >= 0)).size:
        above = (points[live] * lines[at[live]]).sum(1) >= cuts[at[live]]
        at[live] = onward[at[live], above.astype(np.int64)]
    return -1 - at


def _planes(usable: DataFrame, shard_rows: int, sample_rows: int) -> dict[int, tuple]:
    """Planes by number of components, from ``sample_rows`` rows drawn by a hash."""
    total = usable.count()
    sample = usable.orderBy(F.xxhash64("row"), "row").limit(sample_rows).select("dim", "v").toPandas()
    leaf = max(16, round(shard_rows * len(sample) / max(1, total)))
    return {int(d): cut_planes(np.array(own["v"].tolist(), np.float64).reshape(len(own), d), leaf) for d, own in sample.groupby("dim")}


def _dealer(planes: dict[int, tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(batch.schema.names.index("dim")).to_numpy()
            for d in np.unique(dims).tolist():
                own = batch.take(pa.array(np.flatnonzero(dims == d)))
                cells = cell_of(_matrix(own.column(own.schema.names.index("v")), len(own)), planes.get(d))
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(own.schema.names.index(n)) for n in ("row", "vec_id", "dim", "v")), pa.array(cells)],
                    names=["row", "vec_id", "dim", "v", "cell"],
                )

    return run


def _split(dealt: DataFrame, most: int, name: str) -> DataFrame:
    """``dealt`` with a number ``name`` of its cell's part; parts of a cell have about ``most`` rows."""
    parts = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / most).alias("parts"))
    return dealt.join(parts, ["dim", "cell"]).withColumn(
        name, (F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts"))).cast("long"),
    ).drop("parts")


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _shard(key: tuple, table: pa.Table) -> pa.Table:
    ids, rows, vectors = table.column("vec_id").to_numpy(), table.column("row").to_numpy(), _matrix(table.column("v"), len(table))
    order, tree = build_tree(vectors)
    out = {"dim": key[0].as_py(), "shard": key[1].as_py(), "ids": ids[order].tobytes(), "rows": rows[order].tobytes(), "vectors": vectors[order].tobytes()}
    return pa.Table.from_pylist([out | {n: x.tobytes() for n, x in tree.items()}], _arrow(_SHARD))


def _block(key: tuple, table: pa.Table) -> pa.Table:
    """A block's first shard is the first of its cell."""
    columns = [table.column(n).to_numpy().tobytes() for n in ("vec_id", "row")]
    out = dict(
        zip(
            _arrow(_BLOCK).names,
            [key[0].as_py(), key[1].as_py(), key[1].as_py() >> 32 << 32, *columns, _matrix(table.column("v"), len(table)).tobytes()], strict=True,
        )
    )
    return pa.Table.from_pylist([out], _arrow(_BLOCK))


# ---- search


class _Row(dict):
    """A row's binary columns as arrays."""

    def ints(self, name: str) -> np.ndarray:
        return np.frombuffer(self[name], np.int64)

    def vectors(self, name: str, ids: str, kind: type = np.int64) -> np.ndarray:
        return np.frombuffer(self[name], kind).reshape(len(self[ids]) // 8, self["dim"])

    def search(self, k: int, floor: np.ndarray) -> Best:
        own = self.ints("q_rows")
        tree = {n: self.ints(n) for n in ("lo", "hi", "left", "right")} | {"centres": self.vectors("centres", "radii", np.float64), "radii": np.frombuffer(self["radii"])}
        best = Best(len(own), k, floor)
        search(tree, self.vectors("vectors", "ids"), self.ints("ids"), self.ints("rows"), self.vectors("q_vectors", "q_ids"), own, best)
        return best


def _floors(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = _Row(batch.slice(at, 1).to_pylist()[0])
                best = row.search(k, np.full(len(row["q_rows"]) // 8, NONE))
                yield pa.RecordBatch.from_pylist(
                    [{"dim": row["dim"], "block": row["block"], "floor": best.scores[:, -1].tobytes()}], _arrow("dim int, block long, floor binary"),
                )

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block and each shard of a pack, the queries whose bound at the shard's root reaches their floor."""
    for batch in batches:
        for at in range(len(batch)):
            row = _Row(batch.slice(at, 1).to_pylist()[0])
            queries, ids, own = row.vectors("q_vectors", "q_ids"), row.ints("q_ids"), row.ints("q_rows")
            floor = row.ints("floor") if row["floor"] is not None else np.full(len(own), NONE)
            real, out = queries.astype(np.float64), []
            norms = np.sqrt((real**2).sum(1))
            for root in row["roots"]:
                centre, radius = np.frombuffer(root["centre"]), np.frombuffer(root["radius"])[0]
                slack = 1e-9 * (norms * (np.abs(centre).sum() + radius) + 1)
                place = np.flatnonzero(real @ centre + norms * radius + slack >= floor)
                if len(place):
                    parts = [x.tobytes() for x in (ids[place], own[place], queries[place], floor[place], place)]
                    out.append(dict(zip(_arrow(_PAIR).names, [row["dim"], root["shard"], row["block"], *parts, len(own)], strict=True)))
                if len(out) == 16:
                    yield pa.RecordBatch.from_pylist(out, _arrow(_PAIR))
                    out = []
            yield pa.RecordBatch.from_pylist(out, _arrow(_PAIR))


def _searcher(k: int, remembered: int = 1024):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for at in range(len(batch)):
                row = _Row(batch.slice(at, 1).to_pylist()[0])
                key, place = (row["dim"], row["block"]), row.ints("place")
                if len(reached) > remembered:
                    reached.clear()
                known = reached.setdefault(key, np.full(row["size"], NONE))
                best = row.search(k, np.maximum(row.ints("floor"), known[place]))
                known[place] = best.least()
                found = best.scores > NONE
                number = found.sum(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(row.ints("q_rows"), number)), pa.array(np.repeat(row.ints("q_ids"), number)), pa.array(best.ids[found]),
                        pa.array(best.scores[found]),
                    ],
                    names=["row", "query_id", "vec_id", "score"],
                )

    return run


def top_k(vectors: DataFrame, k: int = 10, query_every: int = 100, shard_rows: int = 8192, block_rows: int = 4096, pack: int = 4096, sample_rows: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query.

    Components x become floor(1024 x). Queries are the rows whose vec_id is divisible by ``query_every``;
    candidates are all rows with the same number of components but the query's own. Fewer than k: all. Ties go to
    the smaller vec_id. Null vectors, vectors with a null, NaN or infinite component and rows without a vec_id take
    no part; vectors without components have the product 0 with each other. Rows with the same vec_id are queries and
    candidates each for themselves, so that a query_id then has several lists. An empty table gives no rows. Shards,
    blocks and packs of root balls have about shard_rows, block_rows and ``pack`` rows each, however many there are;
    the cells come from ``sample_rows`` rows, and results do not depend on them. Scores must fit into 64 bits.
    """
    usable = written(_integers(vectors), "vectors")
    dealt = written(usable.mapInArrow(_dealer(_planes(usable, shard_rows, sample_rows)), "row long, vec_id long, dim int, v array<long>, cell long"), "dealt")
    shards = written(_split(dealt, shard_rows, "shard").groupBy("dim", "shard").applyInArrow(_shard, _SHARD), "shards")
    queries = dealt.where(F.col("vec_id") % query_every == 0)
    blocks = written(_split(queries, block_rows, "block").groupBy("dim", "block").applyInArrow(_block, _BLOCK), "blocks")
    floors = written(blocks.join(shards, ["dim", "shard"]).mapInArrow(_floors(k), "dim int, block long, floor binary"), "floors")
    n_packs, salts = max(1, -(-shards.count() // pack)), max(1, blocks.count() // 16)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = lambda c, n: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(n)).cast("int")
    root = F.struct("shard", F.expr("substring(centres, 1, 8 * dim)").alias("centre"), F.expr("substring(radii, 1, 8)").alias("radius"))
    packs = shards.groupBy("dim", number("shard", n_packs).alias("pack")).agg(F.collect_list(root).alias("roots")).withColumn("salt", each(salts))
    asked = blocks.drop("shard").join(floors, ["dim", "block"], "left").withColumn("salt", number("block", salts)).withColumn("pack", each(n_packs))
    pairs = asked.join(packs, ["dim", "pack", "salt"]).mapInArrow(_pairs, _PAIR)
    hits = pairs.join(shards, ["dim", "shard"]).mapInArrow(_searcher(k), _HIT)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
