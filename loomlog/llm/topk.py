"""Exact top-k inner products by Fagin's threshold algorithm.

Each block of vectors keeps one sorted list per dimension; blocks and lists are made once and written to the shared folder. For a
query, lists of positive weights are read from the top and lists of negative weights from the bottom, in growing strides; rows met on
the way are scored exactly (random access), and the sum of weight times frontier over all dimensions bounds every row
not met yet. A query stops in a block as soon as that bound is below its k-th best score so far, which
is carried from block to block, so later blocks often end before their first read. All queries of a
pass go together, as matrix products.

A pass takes at most ``query_block`` queries: they are broadcast, their answers are written, and the broadcast is destroyed before the
next pass begins, so neither the driver nor a task holds more however many queries there are. Each task returns k rows a query at
most, and a ranked window merges them.

Components become floor(1024 * x) exactly. Products run in doubles only where every partial sum is a
whole number below 2^53, otherwise in unbounded integers, cut to the range of a long at the end.

Defined cases: vectors that are null, or hold a null, a non-finite component or one whose whole number is beyond a long, take no
part, nor do rows with a null id; only vectors of a query's own length are its candidates; rows with
the query's id are never its candidates; each of several rows with one query id is a query of its own, and the best of their joint
answers are returned for the id; equal scores rank by smaller id; rows that are equal in id and vector count once for a query; vectors of any
length are whole, the longer the fewer go in a block; without vectors or queries the result is empty; columns besides id and vector are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, stage, table

K = 10
SCALE = 1024
QUERY_BLOCK = 8192
BLOCK = 8192
BLOCK_BYTES = 4 << 20
FIRST = 16
LONG = (-(1 << 63), (1 << 63) - 1)


def whole(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors of whole numbers as doubles or exact objects) of the usable rows, per length."""
    ids, vectors = batch.column(0), batch.column(1)
    if isinstance(vectors.type, pa.ListType) and ids.null_count == 0 and vectors.null_count == 0 and batch.num_rows:
        flat = vectors.flatten()
        n = len(flat) // batch.num_rows
        lengths = np.diff(vectors.offsets.to_numpy())
        if flat.null_count == 0 and (lengths == n).all() and n:
            x = np.floor(SCALE * flat.to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, n)
            fine = (np.abs(x) < 2.0**63).all(axis=1)  # false for nan and infinities
            yield ids.to_numpy()[fine], x[fine]
            return
    groups: dict[int, tuple[list, list]] = {}
    for key, vector in zip(ids.to_pylist(), vectors.to_pylist()):
        if key is None or vector is None or any(c is None or not math.isfinite(c) for c in vector):
            continue
        row = [math.floor(SCALE * float(c)) if abs(float(c)) < 2.0**63 else 1 << 64 for c in vector]
        if all(LONG[0] <= c <= LONG[1] for c in row):
            kept = groups.setdefault(len(row), ([], []))
            kept[0].append(key)
            kept[1].append(row)
    for n, (keys, rows) in groups.items():
        yield np.array(keys, dtype=np.int64), np.array(rows, dtype=np.float64).reshape(len(keys), n)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(queries)]
        self.least = np.full(queries, -np.inf)

    def add(self, q: int, scores, ids) -> None:
        pool = {(-int(s), int(i)) for s, i in zip(scores, ids)}
        pool.update(self.rows[q])
        self.rows[q] = sorted(pool)[: self.k]
        if len(self.rows[q]) == self.k:
            self.least[q] = float(-self.rows[q][-1][0])


def sorted_block(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of id, and for each dimension the rows' places in order of their component."""
    order = np.argsort(ids, kind="stable")
    return ids[order], vectors[order], np.argsort(vectors[order], axis=0, kind="stable")


def threshold_search(
    query_ids: np.ndarray, queries: np.ndarray, block: tuple[np.ndarray, np.ndarray, np.ndarray], best: Best, which: np.ndarray
) -> int:
    """Puts the rows of a ``sorted_block`` that belong among each query's k best into ``best``; returns how many rows were scored.

    ``which`` are the queries' places in ``best``.
    """
    ids, vectors, lists = block
    n, d = vectors.shape
    if not n or not len(queries):
        return 0
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(d, 1)
    exact = largest < 2.0**52
    q_all, v_all = (queries, vectors) if exact else (_objects(queries), _objects(vectors))
    # Bounds may lose the last bits of a sum; this slack keeps them bounds.
    slack = 0.0 if exact else largest * 1e-12 + 1
    ordered = np.take_along_axis(vectors, lists, axis=0)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    active = np.arange(len(queries))
    met = np.zeros(n, dtype=bool)
    depth = scored = 0
    while len(active):
        if depth < n:
            bound = up[active] @ ordered[n - 1 - depth] + down[active] @ ordered[depth] + slack
            active = active[bound >= best.least[which[active]]]
            if not len(active):
                break
        else:
            break
        reach = min(n, max(FIRST, depth * 4))
        above, below = (up[active] > 0).any(axis=0), (down[active] < 0).any(axis=0)
        new = np.zeros(n, dtype=bool)
        new[lists[n - reach : n - depth, above].ravel()] = True
        new[lists[depth:reach, below].ravel()] = True
        if reach == n:
            new[:] = True  # also the rows of queries without any weight
        new &= ~met
        met |= new
        rows = np.flatnonzero(new)
        depth = reach
        scored += len(rows) * len(active)
        for start in range(0, len(rows), BLOCK):
            part = rows[start : start + BLOCK]
            scores = q_all[active] @ v_all[part].T
            _collect(scores, active, part, query_ids, ids, best, which)
    return scored


def _objects(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def _collect(scores, active, part, query_ids, ids, best: Best, which) -> None:
    k = best.k
    names = ids[part]
    repeated = bool((names[1:] == names[:-1]).any())
    for row, q in zip(scores, active):
        place = which[q]
        other = names != query_ids[q]
        least = best.least[place]
        if row.dtype == object:
            picked = np.array([i for i in np.flatnonzero(other) if float(row[i]) >= least or len(best.rows[place]) < k], dtype=np.int64)
            best.add(place, [min(max(int(row[i]), LONG[0]), LONG[1]) for i in picked], names[picked])
            continue
        picked = np.flatnonzero(other & (row >= least))
        if repeated and len(picked) > 4 * k:
            picked = _once(picked, names, row)  # copies of a row must not take more than one of the k ranks
        if len(picked) > 4 * k:
            # Rows are in order of id, so the first ones of the lowest kept score are the right ones.
            kept = row[picked]
            cut = np.partition(kept, -k)[-k]
            picked = np.r_[picked[kept > cut], picked[kept == cut][:k]]
        if len(picked):
            best.add(place, row[picked], names[picked])


def _once(picked: np.ndarray, names: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The first of the places of each (id, score), in order of id."""
    picked = picked[np.lexsort((row[picked], names[picked]))]
    name, score = names[picked], row[picked]
    return picked[np.r_[True, (name[1:] != name[:-1]) | (score[1:] != score[:-1])]]


def _rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of at most ``size`` rows, and of about ``BLOCK_BYTES``, with vectors of one length each."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def cut(n: int, all_of_it: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        most = max(1, min(size, BLOCK_BYTES // (8 * n or 1)))
        kept = held.pop(n)
        ids, vectors = np.concatenate([i for i, _ in kept]), np.concatenate([v for _, v in kept])
        stop = len(ids) if all_of_it else len(ids) - len(ids) % most
        for at in range(0, stop, most):
            yield ids[at : min(at + most, stop)], vectors[at : min(at + most, stop)]
        if stop < len(ids):
            held[n] = [(ids[stop:], vectors[stop:])]

    for batch in batches:
        for ids, vectors in whole(batch):
            n = vectors.shape[1]
            held.setdefault(n, []).append((ids, vectors))
            if sum(len(i) for i, _ in held[n]) >= min(size, BLOCK_BYTES // (8 * n or 1)):
                yield from cut(n, False)
    for n in list(held):
        yield from cut(n, True)


_BLOCK = "width int, ids binary, vectors binary, whole boolean, lists binary"


def make_blocks(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of ``(id, vector)`` rows with their sorted lists, a row each: components as 32-bit numbers where they fit, else as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in _rows(batches, block):
            ids, found, lists = sorted_block(ids, found)
            small = bool(np.abs(found).max(initial=0) < 2**31)
            row = [found.shape[1], ids.astype("<i8").tobytes(), found.astype("<i4" if small else "<f8").tobytes(), small, lists.astype("<u2" if len(ids) <= 1 << 16 else "<u4").tobytes()]
            types = [pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["width", "ids", "vectors", "whole", "lists"])

    return vectors.mapInArrow(run, _BLOCK)


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            width, ids, vectors, small, lists = (batch.column(k)[i] for k in range(5))
            ids = np.frombuffer(ids.as_buffer(), "<i8")
            shape = (len(ids), width.as_py())
            vectors = np.frombuffer(vectors.as_buffer(), "<i4" if small.as_py() else "<f8").astype(np.float64).reshape(shape)
            yield ids, vectors, np.frombuffer(lists.as_buffer(), "<u2" if len(ids) <= 1 << 16 else "<u4").astype(np.int64).reshape(shape)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
    query_block: int = QUERY_BLOCK, block: int = BLOCK,
) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` best rows of ``vectors`` for each row of ``queries``."""
    spark = vectors.sparkSession
    folder = new_folder(spark, "topk")
    out = f"query_id bigint, {id_col} bigint, score bigint"
    pick = lambda df: df.select(F.col(id_col).cast("bigint"), F.col(vector_col).cast("array<double>"))
    wanted = stage(pick(queries).where(f"`{id_col}` is not null and `{vector_col}` is not null").distinct(), "queries", folder)
    blocks = stage(make_blocks(pick(vectors), block), "blocks", folder)
    # Ranges of ids, so that every row is in one pass; the different vectors of one id stay together. The quantiles may
    # be off by a quarter of a range at either end, and ranges are two thirds of a pass.
    passes = max(1, -(-3 * wanted.count() // (2 * query_block)))
    edges = wanted.approxQuantile(id_col, [i / passes for i in range(1, passes)], 0.25 / passes) if passes > 1 else []
    edges = sorted(set(edges))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    answers = spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score bigint")
    written = False
    for i, (low, high) in enumerate(zip([None, *edges], [*edges, None])):
        rows = wanted
        rows = rows if low is None else rows.where(F.col(id_col) >= low)
        rows = rows if high is None else rows.where(F.col(id_col) < high)
        groups: dict[int, tuple[list, list]] = {}
        for batch in rows.toArrow().combine_chunks().to_batches():
            for ids, found in whole(batch):
                kept = groups.setdefault(found.shape[1], ([], []))
                kept[0].append(ids)
                kept[1].append(found)
        asked = {n: (np.concatenate(i), np.concatenate(v)) for n, (i, v) in groups.items()}
        if not asked:
            continue
        shared = spark.sparkContext.broadcast(asked)
        found = blocks.mapInArrow(_searcher(shared, k, id_col), out).distinct()
        found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        found.select("query_id", "rank", id_col, "score").write.parquet(f"{folder}/answers/pass={i}")
        shared.destroy()
        written = True
    return spark.read.schema(answers.schema).parquet(f"{folder}/answers").select(*answers.columns) if written else answers


def _searcher(shared, k: int, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        starts, at = {}, 0
        for n, (ids, _) in asked.items():
            starts[n] = at
            at += len(ids)
        best = Best(at, k)
        names = np.concatenate([ids for ids, _ in asked.values()])
        for block in _read_blocks(batches):
            width = block[1].shape[1]
            if width in asked:
                q_ids, q = asked[width]
                threshold_search(q_ids, q, block, best, np.arange(len(q_ids)) + starts[width])
        found = [(int(names[q]), i, -s) for q, rows in enumerate(best.rows) for s, i in rows]
        for start in range(0, len(found), 65536):
            a, b, c = zip(*found[start : start + 65536])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["query_id", id_col, "score"])

    return run


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
