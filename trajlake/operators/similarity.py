"""Exact cosine similarity joins over embedding columns, and deduplication rules on top of them.

A stated set of queries goes in blocks against all rows (scores, top_k). All rows against all rows (nearest_of_all) is a
Cartesian product of rows that hold thousands of packed vectors each, so that vectors are shuffled and written once, however
many pairs there are. The angle between vectors is a metric: bounds on the angles to a few pivots tell which vectors of two
packs can form a pair over the cutoff at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlake.operators.order import pinned, pinned_folder

PAIR = "query_id long, index_id long, score double"


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm == 0, 1.0, norm)


def _vectors(df: DataFrame, id_: str, vec: str) -> DataFrame:
    """(id, v) of the rows that can be compared: with an id and a vector of finite entries of the usual width.

    That is the number of entries that most vectors have, of equally many the least; vectors of another width match nothing.
    """
    v = F.col(vec).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is greater than inf here
    rows = df.filter(F.col(id_).isNotNull() & (F.size(v) > 0) & finite).select(F.col(id_).cast("long").alias("id"), v.alias("v"))
    width = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    return rows.filter(F.size("v") == width[0]) if width else rows


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _blocks(queries: DataFrame, block_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (id, v) as (ids, unit vectors) in blocks of at most block_rows rows, one on the driver at a time."""
    ids, vecs = [], []
    for r in queries.toLocalIterator():
        ids.append(r[0])
        vecs.append(r[1])
        if len(ids) == block_rows:
            yield np.array(ids), _unit(np.array(vecs))
            ids, vecs = [], []
    if ids:
        yield np.array(ids), _unit(np.array(vecs))


def scores(queries: DataFrame, index: DataFrame, id_: str, vec: str, k: int | None = None, cutoff: float | None = None, block_rows: int = 4096) -> DataFrame:
    """(query_id, index_id, score): cosine of pairs, only those over the cutoff, or the best k of each query in each batch.

    The queries are a stated set that goes against all rows of the index in blocks of bounded size; the index is never
    collected or shuffled. If there is more than one block, each block's hits are written to the shared folder before the
    next one is read, so that the driver holds one block however many there are. Zero vectors score 0; rows without an id, or
    whose vector is null, of another width than the index's usual one or not finite, match nothing.
    """
    spark, rows = index.sparkSession, _vectors(index, id_, vec)

    def against(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or len(b.column(1)[0]) != q.shape[1]:
                    continue
                other = b.column(0).to_numpy()
                s = q @ _unit(_matrix(b.column(1), q.shape[1])).T
                if cutoff is not None:
                    i, j = np.nonzero(s > cutoff)
                else:
                    m = min(k, s.shape[1])
                    j = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    edge = np.take_along_axis(s, j, axis=1).min(1)
                    i, j = np.nonzero(s >= edge[:, None])  # ties at the edge are settled later, by id
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(other[j]), pa.array(s[i, j])], ["query_id", "index_id", "score"])

        return rows.mapInArrow(run, PAIR)

    first, path = None, None
    for block in _blocks(_vectors(queries, id_, vec), block_rows):
        if first is None:
            first = block
            continue
        if path is None:
            path = f"{pinned_folder(spark)}/hits-{uuid.uuid4().hex}"
            against(*first).write.parquet(path)
        against(*block).write.mode("append").parquet(path)
    if first is None:
        return spark.createDataFrame([], PAIR)
    return against(*first) if path is None else spark.read.schema(PAIR).parquet(path)


def top_k(queries: DataFrame, index: DataFrame, id_: str, vec: str, k: int, exclude_self: bool = False, block_rows: int = 4096) -> DataFrame:
    """(query_id, index_id, score, rank): the k nearest of each query; of equal scores the smaller id first."""
    s = scores(queries, index, id_, vec, k=k + exclude_self, block_rows=block_rows)
    if exclude_self:
        s = s.filter("query_id <> index_id")
    s = s.withColumn("_s", F.round("score", 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("_s"), "index_id")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_s")


def drop_similar_to(a: DataFrame, b: DataFrame, id_: str, vec: str, cutoff: float, k: int = 3, block_rows: int = 4096) -> DataFrame:
    """Rows of a that are not among the k nearest of a row of b with a score over the cutoff."""
    hit = top_k(b, a, id_, vec, k, block_rows=block_rows).filter(F.col("score") > cutoff)
    return a.join(hit.select(F.col("index_id").alias(id_)).distinct(), id_, "left_anti")


def drop_similar_or_named(a: DataFrame, b: DataFrame, id_: str, vec: str, text: str, words: list[str], cutoff: float = 0.9, block_rows: int = 4096) -> DataFrame:
    """Rows of a whose nearest row of b scores at most the cutoff and whose text has none of the words.

    Each row of a asks for one neighbour in b, a set of stated size, which goes against all rows of a in blocks.
    """
    near = scores(b, a, id_, vec, cutoff=cutoff, block_rows=block_rows).select(F.col("index_id").alias(id_)).distinct()
    named = F.lit(False)
    for w in words:
        named = named | F.contains(F.col(text), F.lit(w))
    return a.filter(~F.coalesce(named, F.lit(False))).join(near, id_, "left_anti")


def known_bad(a: DataFrame, bad: DataFrame, id_: str, vec: str, at_least: float = 0.99, block_rows: int = 4096) -> DataFrame:
    """Rows of a without the nearest row of each bad one; an error if a bad row has no neighbour that near."""
    best = top_k(bad, a, id_, vec, 1, block_rows=block_rows)
    sure = best.withColumn("index_id", F.when(F.col("score") >= at_least, F.col("index_id")).otherwise(F.raise_error(F.concat(F.lit("no near row for "), F.col("query_id").cast("string"))).cast("long")))
    return a.join(sure.select(F.col("index_id").alias(id_)).distinct(), id_, "left_anti")


PIVOTS = 256  # at most; they and their cells' sizes and radii are all that the driver sees


@dataclass
class Cells:
    """Pivots (unit rows), and of each pivot's cell the number of rows, of blocks, and the greatest angle to the pivot."""

    pivots: np.ndarray
    rows: np.ndarray
    blocks: np.ndarray
    radius: np.ndarray

    def reach(self, v: np.ndarray, p: int, q: int, most: float) -> np.ndarray:
        """For unit rows v of the cell p: can a row of the cell q be within the angle `most`?

        For x in the cell of p and y in that of q with an angle of at most `most`, the triangle inequality gives (x, q) <= most +
        (y, q) <= most + radius of q; and as q is y's nearest pivot, (y, q) <= (y, p) <= most + (x, p).
        """
        own, other = _angles(v, self.pivots[[p, q]]).T
        return (other <= most + self.radius[q] + SLACK) & (other <= own + 2 * most + SLACK)

    def compared(self, most: float) -> float:
        """The share of all pairs of rows that lie in pairs of cells which bounds on the cells alone can't tell apart."""
        between = _angles(self.pivots, self.pivots)
        near = between <= most + self.radius[:, None] + self.radius[None, :] + SLACK
        return float((self.rows[:, None] * self.rows[None, :] * near).sum() / max(1, self.rows.sum() ** 2))


SLACK = 2e-3  # above what rounding does to an angle, to single precision too: arccos turns 1e-7 near 1 into 5e-4
PACK_BYTES, PACKS = 1 << 21, 4  # of a pack's vectors at most; packs in a partition of the product
TILE = 256  # rows whose scores with another cell's rows are held at once


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def cells_of(rows: DataFrame, block_rows: int) -> Cells | None:
    """Cells of rows (id, v): a pivot for each block_rows rows, PIVOTS at most, taken by a hash of the vector; null of an empty table.

    Equal vectors are one pivot. A zero vector is at a right angle to all and so in some cell.
    """
    n = rows.count()
    if not n:
        return None
    wanted = min(PIVOTS, max(1, round(n / block_rows)))
    got = rows.groupBy(F.xxhash64("v").alias("h")).agg(F.min("v").alias("v")).orderBy("h").limit(wanted).collect()
    pivots = _unit(np.array([r["v"] for r in got]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                angles = _angles(_unit(_matrix(b.column(1), pivots.shape[1])), pivots)
                cell = angles.argmin(1)
                far, count = np.zeros(len(pivots)), np.bincount(cell, minlength=len(pivots))
                np.maximum.at(far, cell, angles[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots))), pa.array(count), pa.array(far)], ["cell", "n", "far"])

    told = rows.mapInArrow(run, "cell long, n long, far double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()
    size, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in told:
        size[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
    return Cells(pivots, size, np.maximum(1, -(-size // block_rows)), radius)


def _best(row: np.ndarray, index: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k pairs of each row with the greatest scores, of equal ones those with the least index."""
    order = np.lexsort((index, -score, row))
    row, index, score = row[order], index[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], index[keep], score[keep]


@dataclass
class Pack:
    """Vectors of some cells by cell and id: raw, as single precision unit rows, and where each cell's rows lie.

    Of equal vectors only those with the least ids can be among any row's k nearest; they are told by `first`.
    """

    cells: dict[int, slice]
    ids: np.ndarray
    first: np.ndarray
    raw: np.ndarray
    unit: np.ndarray

    @classmethod
    def read(cls, cell: bytes, ids: bytes, first: bytes, raw: bytes, dtype: str) -> Pack:
        at = np.frombuffer(cell, np.int32)
        start = np.flatnonzero(np.diff(at, prepend=-1))
        v = np.frombuffer(raw, dtype).reshape(len(at), -1)
        cells = {int(at[a]): slice(a, e) for a, e in zip(start, [*start[1:], len(at)])}
        return cls(cells, np.frombuffer(ids, np.int64), np.frombuffer(first, np.bool_), v, _unit(v.astype(np.float64)).astype(np.float32))


def _first_of_equal(ids: np.ndarray, raw: np.ndarray, k: int) -> np.ndarray:
    """Which rows are, of those with an equal vector, among the first k of one of the k + 1 least ids.

    Whatever id is left out, the k rows with the least other ids are among them.
    """
    same = np.unique(np.ascontiguousarray(raw).view(np.dtype((np.void, raw.shape[1] * raw.itemsize))).ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, same))
    of, by = same[order], ids[order]
    new_vector = np.diff(of, prepend=-1) != 0
    new_id = new_vector | (np.diff(by, prepend=by[:1]) != 0)
    at, rank = np.arange(len(ids)), np.cumsum(new_id)
    nth_id = rank - rank[np.maximum.accumulate(np.where(new_vector, at, 0))]
    nth_row = at - np.maximum.accumulate(np.where(new_id, at, 0))
    out = np.empty(len(ids), np.bool_)
    out[order] = (nth_id <= k) & (nth_row < k)
    return out


def _rough(width: int) -> float:
    """Scores of unit rows in single precision are nearer than that to exact ones, rounded to nine places."""
    return (width + 8) * 2.0**-23 + 1e-9


def _exact(a: np.ndarray, i: np.ndarray, c: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for n in range(0, len(i), 1 << 14):
        e = slice(n, n + (1 << 14))
        out[e] = np.einsum("ij,ij->i", _unit(a[i[e]].astype(np.float64)), _unit(c[j[e]].astype(np.float64)))
    return np.round(out, 9)


def _crowded(s: np.ndarray, ids: np.ndarray, other_ids: np.ndarray, k: int, low: float, off: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) of rough scores that can be over low and among the best k of their row; columns are in the order of ids."""
    lo, hi = np.searchsorted(other_ids, ids), np.searchsorted(other_ids, ids, "right")
    for i in np.flatnonzero(hi > lo):
        s[i, lo[i] : hi[i]] = -np.inf
    least = np.full((len(s), 1), low, np.float32)
    if s.shape[1] > k:
        least[:, 0] = np.maximum(least[:, 0], np.partition(s, s.shape[1] - k, axis=1)[:, -k] - np.float32(2 * off))
    return np.divmod(np.flatnonzero((s >= least) & (s > -np.inf)), s.shape[1])


def _compared(a: Pack, c: Pack, cells: Cells, most: float, k: int, cutoff: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, index, score) of rows of two packs, both ways, or of one with itself; among them the best k of each row.

    Scores in single precision tell which pairs can be over the cutoff and, where there are many, among the best k.
    """
    off = _rough(a.raw.shape[1])
    low = -np.inf if cutoff is None else np.float32(cutoff - off)

    def ways(i: np.ndarray, j: np.ndarray, x: np.ndarray, there: np.ndarray, back: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if cutoff is not None:
            there, back = there & (x > cutoff), back & (x > cutoff)
        yield _best(a.ids[i[there]], c.ids[j[there]], x[there], k)
        yield _best(c.ids[j[back]], a.ids[i[back]], x[back], k)

    for p, rows in a.cells.items():
        for q, others in c.cells.items():
            i, j = np.arange(rows.start, rows.stop), np.arange(others.start, others.stop)
            if most < np.pi:
                i, j = i[cells.reach(a.unit[rows], p, q, most)], j[cells.reach(c.unit[others], q, p, most)]
            if not len(i) or not len(j):
                continue
            right, fj = c.unit[j].T, j[c.first[j]]
            for t in range(0, len(i), TILE):
                r = i[t : t + TILE]
                s = a.unit[r] @ right
                n = s.size if cutoff is None else np.count_nonzero(s >= low)
                if n <= 2 * k * (len(r) + len(j)):
                    if n:
                        x, y = np.divmod(np.flatnonzero(s >= low), len(j))
                        x, y = r[x], j[y]
                        other = a.ids[x] != c.ids[y]
                        yield from ways(x, y, _exact(a.raw, x, c.raw, y), other & c.first[y], other & a.first[x] & (a is not c))
                    continue
                f = r[a.first[r]]
                if a is not c and len(f):
                    y, x = _crowded(np.ascontiguousarray(s[a.first[r]].T), c.ids[j], a.ids[f], k, low, off)
                    x, y, some = f[x], j[y], np.ones(len(x), np.bool_)
                    yield from ways(x, y, _exact(a.raw, x, c.raw, y), ~some, some)
                if len(fj):
                    x, y = _crowded(s if len(fj) == len(j) else s[:, c.first[j]], a.ids[r], c.ids[fj], k, low, off)
                    x, y, some = r[x], fj[y], np.ones(len(x), np.bool_)
                    yield from ways(x, y, _exact(a.raw, x, c.raw, y), some, ~some)


def nearest_of_all(df: DataFrame, id_: str, vec: str, k: int, block_rows: int = 2048, cutoff: float | None = None) -> DataFrame:
    """(query_id, index_id, score): the k nearest other rows of every row, of those over the cutoff if there is one; of equal scores
    (nine places) the smaller id first.

    Exact. Rows belong to the cell of their nearest pivot; cells are dealt to blocks of some block_rows rows, blocks to packs of
    some four blocks, and each pack is one row of a checkpointed table. Tasks of that table's Cartesian product with itself
    read two of its partitions and compare each pack of one with each of the other, leaving out rows that can't have a match in a
    cell (Cells.reach). So the work is quadratic where vectors have no clusters, or without a cutoff, while a vector
    is shuffled once and written once, and a task holds a few packs and gives k pairs at most for each of its rows. Rows without an
    id, or whose vector is null, not finite or of another width than most, have no neighbours; zero vectors score 0;
    rows with equal ids are not each other's neighbours.
    """
    spark, rows = df.sparkSession, _vectors(df, id_, vec)
    cells = cells_of(rows, block_rows)
    if cells is None:
        return spark.createDataFrame([], PAIR)
    most = np.pi if cutoff is None else float(np.arccos(np.clip(cutoff, -1.0, 1.0)))
    if cutoff is not None and cutoff < 0:
        most = np.pi  # a zero vector's score of 0 is over it, whatever its angle
    width = cells.pivots.shape[1]
    dtype = "float32" if df.schema[vec].dataType.simpleString() == "array<float>" else "float64"
    pack_rows = max(1, min(4 * block_rows, PACK_BYTES // (width * np.dtype(dtype).itemsize)))
    blocks = np.maximum(cells.blocks, -(-cells.rows // pack_rows))
    base = np.concatenate([[0], np.cumsum(blocks)])
    size = np.repeat(cells.rows / blocks, blocks)
    pack_of = ((np.cumsum(size) - size) // pack_rows).astype(np.int64)
    packs = int(pack_of[-1]) + 1
    parts = max(-(-packs // PACKS), min(packs, int(np.ceil(np.sqrt(8 * spark.sparkContext.defaultParallelism)))))
    mixer = np.random.default_rng(1).integers(1, 1 << 63, width, np.uint64) | np.uint64(1)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                ids, v = part.column(0).to_numpy(), _matrix(part.column(1), width)
                cell = _angles(_unit(v), cells.pivots).argmin(1)
                mixed = ((ids.astype(np.uint64) + (v.view(np.uint64) * mixer).sum(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                block = base[cell] + (mixed % blocks[cell].astype(np.uint64)).astype(np.int64)
                packed = [x.tobytes() for x in v.astype(dtype)]
                yield pa.RecordBatch.from_arrays([pa.array(pack_of[block]), pa.array(cell.astype(np.int32)), pa.array(ids), pa.array(packed, pa.binary())], ["pack", "cell", "id", "v"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        pack, cell, ids = (t.column(i).to_numpy() for i in range(3))
        v = np.frombuffer(b"".join(t.column(3).to_pylist()), dtype).reshape(len(ids), width)
        for n in np.unique(pack):
            i = np.flatnonzero(pack == n)
            i = i[np.lexsort((ids[i], cell[i]))]
            columns = [x.tobytes() for x in (cell[i], ids[i], _first_of_equal(ids[i], v[i], k), v[i])]
            yield pa.RecordBatch.from_arrays([pa.array([n]), *[pa.array([x], pa.binary()) for x in columns]], ["pack", "cell", "id", "first", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, left = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0, (None, None)
        for b in batches:
            for n in range(b.num_rows):
                a_pack, c_pack = b.column(0)[n].as_py(), b.column(5)[n].as_py()
                if left[0] != a_pack:
                    left = a_pack, Pack.read(*[b.column(x)[n].as_py() for x in range(1, 5)], dtype)
                right = left[1] if a_pack == c_pack else Pack.read(*[b.column(x)[n].as_py() for x in range(6, 10)], dtype)
                for got in _compared(left[1], right, cells, most, k, cutoff):
                    held.append(got)
                    count += len(got[0])
                    if count > 1 << 20:
                        held = [_best(*[np.concatenate(x) for x in zip(*held)], k)]
                        count = 0
        best = _best(*[np.concatenate(x) for x in zip(*held)], k)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["query_id", "index_id", "score"])

    table, part = rows.mapInArrow(sent, "pack long, cell int, id long, v binary"), (F.col("pack") % parts).cast("int")
    table = table.repartitionById(parts, part) if hasattr(table, "repartitionById") else table.repartition(parts, part)
    table = pinned(table.mapInArrow(together, "pack long, cell binary, id binary, first binary, v binary"))
    other = table.select(*[F.col(c).alias(f"{c}_2") for c in table.columns]).hint("shuffle_replicate_nl")
    # each two packs meet in one of their two places, so that all tasks have some work
    once = F.when((F.col("pack") + F.col("pack_2")) % 2 == 0, F.col("pack") >= F.col("pack_2")).otherwise(F.col("pack") < F.col("pack_2"))
    pairs = table.join(other, once).mapInArrow(compare, PAIR)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "index_id")
    return pairs.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def greedy_dedupe(df: DataFrame, id_: str, vec: str, cutoff: float = 0.792, k: int = 5, block_rows: int = 2048, max_rounds: int = 100) -> DataFrame:
    """Rows that stay if rows are taken in the order of ids and each that still stays drops those of its k - 1 nearest others
    that score over the cutoff.

    Exact: a row is settled once all smaller rows that could drop it are. Rounds go over the edge table, which is
    checkpointed; their number is the longest chain of such rows, and no edge reaches the driver.
    """
    edges = nearest_of_all(df, id_, vec, k - 1, block_rows, cutoff).select(F.col("query_id").alias("u"), F.col("index_id").alias("v"))
    edges = pinned(edges)
    state = pinned(edges.select(F.col("u").alias("x")).union(edges.select("v")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    for _ in range(max_rounds):
        # u drops v if u stays when its turn comes: v's fate waits for the droppers that come before it;
        # a later dropper removes v too, but only after v has had its own turn
        told = edges.join(state.select(F.col("x").alias("u"), F.col("kept").alias("ku")), "u")
        before = told.filter("u < v").groupBy(F.col("v").alias("x")).agg(F.max(F.col("ku")).alias("some_kept"), F.count_if(F.col("ku").isNull()).alias("open"))
        fate = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("some_kept", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = pinned(state.join(before, "x", "left").select("x", fate.alias("kept")))
        if state.filter("kept is null").isEmpty():
            break
    else:
        raise RuntimeError("greedy deduplication did not settle")
    turn = edges.join(state.filter("kept").select(F.col("x").alias("u")), "u").select(F.col("v").alias(id_)).distinct()
    return df.join(turn, id_, "left_anti")
