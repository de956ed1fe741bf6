import math
import random

import numpy as np
import pytest

from loomlog.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, score string, query_id int"


def brute(rows, k=10, every=10):
    good = []
    for key, vector, *_ in rows:
        if key is not None and vector is not None and all(c is not None and math.isfinite(c) for c in vector):
            good.append((key, [math.floor(1024 * float(np.float32(c))) for c in vector]))
    out = {}
    for key, q in good:
        if key % every == 0:
            found = {(-sum(a * b for a, b in zip(q, v)), other) for other, v in good if other != key and len(v) == len(q)}
            out.setdefault(key, set()).update(found)
    return sorted((q, r, i, -s) for q, found in out.items() for r, (s, i) in enumerate(sorted(found)[:k], 1))


def rows():
    rng = random.Random(12)
    out = [(i, [rng.uniform(-1, 1) for _ in range(8)], "", 0) for i in range(300)]
    out += [(1000 + i, out[7][1], "", 0) for i in range(80)]  # ties
    out += [(2000 + i, [0.0] * 8, "", 0) for i in range(15)]
    out += [(3000, None, "", 0), (None, [1.0] * 8, "", 0), (3010, [float("nan")] * 8, "", 0), (3020, [float("inf")] + [0.0] * 7, "", 0)]
    out += [(3030, [None] + [0.5] * 7, "", 0), (3040, [0.5, 0.25], "", 0), (3041, [1.0, 2.0], "", 0), (3050, [], "", 0), (3051, [], "", 0)]
    return out + [out[20], out[33]]


@pytest.mark.parametrize("limits", [{}, {"query_block": 7, "block": 32}, {"block": 1}])
def test_matches_brute_force(spark, limits):
    data = rows()
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = topk.top_k(frame, frame.where("vec_id % 10 = 0"), **limits).collect()
    assert sorted(map(tuple, got)) == brute(data)


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    data = [(i, [rng.choice([-1, 1]) * rng.uniform(1e5, 1e6) for _ in range(5)], "", 0) for i in range(60)]
    frame = spark.createDataFrame(data, SCHEMA)
    assert sorted(map(tuple, topk.top_k(frame, frame.where("vec_id % 10 = 0")).collect())) == brute(data)


@pytest.mark.parametrize("copies", [3, 20])
@pytest.mark.parametrize("limits", [{}, {"block": 64}])
def test_repeated_rows_take_one_rank(spark, copies, limits):
    rng = random.Random(copies)
    data = [(i, [rng.uniform(-1, 1) for _ in range(8)], "", 0) for i in range(120)] * copies
    # Different vectors of one id that score the same for queries without weight on the first component.
    data += [(500, [rng.uniform(-1, 1)] + [1.0] * 7, "", 0) for _ in range(60)] + [(510, [0.0] + [1.0] * 7, "", 0)] * copies
    frame = spark.createDataFrame(data, SCHEMA).coalesce(1)
    got = topk.top_k(frame, frame.where("vec_id % 10 = 0").dropDuplicates(["vec_id"]), **limits)
    assert 500 in {r.vec_id for r in got.where("query_id = 510").collect()}
    want = [r for r in brute(data) if r[0] != 500]
    assert sorted(tuple(r) for r in got.where("query_id <> 500").collect()) == want and len(want) == 13 * 10


def test_the_bound_saves_reads():
    rng = np.random.default_rng(0)
    vectors = np.floor(rng.normal(size=(20_000, 2)) * 1000)
    vectors[0] = [90_000, 90_000]
    ids = np.arange(len(vectors))
    queries = np.array([[500.0, 700.0]])
    best = topk.Best(1, 1)
    scored = topk.threshold_search(np.array([-1]), queries, topk.sorted_block(ids, vectors), best, np.arange(1))
    assert best.rows[0][0][1] == 0 and scored < len(vectors) / 50


def test_blocks_are_bounded_and_whole(spark):
    rng = random.Random(1)
    data = [(i, [rng.uniform(-1, 1) for _ in range(n)]) for n in (3, 20_000) for i in range(60)] + [(900, [1e300] * 3)]
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").coalesce(1)
    blocks = topk.make_blocks(frame, block=25).collect()
    sizes = sorted((b.width, len(b.ids) // 8) for b in blocks)
    assert [n for w, n in sizes if w == 3] == [10, 25, 25] and all(w * n * 8 <= topk.BLOCK_BYTES for w, n in sizes) and sum(n for w, n in sizes if w > 3) == 60


def test_the_driver_holds_one_pass(spark, monkeypatch):
    """Queries reach the driver a pass at a time, and each pass's broadcast is gone before the next."""
    rng = random.Random(9)
    data = [(i, [rng.uniform(-1, 1) for _ in range(4)], "", 0) for i in range(400)]
    frame = spark.createDataFrame(data, SCHEMA)
    alive, sizes = set(), []
    real = type(spark.sparkContext).broadcast

    def counted(self, value):
        out = real(self, value)
        assert not alive
        alive.add(out.id if hasattr(out, "id") else id(out))
        sizes.append(sum(len(ids) for ids, _ in value.values()))
        destroy = out.destroy
        out.destroy = lambda *a, **kw: (alive.clear(), destroy(*a, **kw))
        return out

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", counted)
    got = topk.top_k(frame, frame, query_block=60).count()
    assert got == 4000 and len(sizes) >= 10 and max(sizes) <= 60 and sum(sizes) == 400


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(frame, frame).count() == 0
    one = spark.createDataFrame([(1, [1.0], "", 0)], SCHEMA)
    assert topk.top_k(frame, one).count() == 0 and topk.top_k(one, frame).count() == 0
