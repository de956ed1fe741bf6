import json
import random

import pytest

from loomlog import Engine
from loomlog.cli import answer, arguments
from loomlog.operators import pruning
from loomlog.sources import ndjson, store
from loomlog.streaming import ingest


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")


def records(n):
    return [{"id": i, "user": f"u{i % 5}", "extra": i} if i >= 60 else {"id": i, "user": f"u{i % 5}", "at": f"2023-01-{1 + i // 10:02d} 00:00:00"} for i in range(n)]


@pytest.fixture
def saved(spark, tmp_path):
    write(tmp_path / "in" / "a.json", records(100))
    e = Engine.from_files(spark, str(tmp_path / "in"), block_size=20)
    e.save(f"file://{tmp_path}/store")
    return f"file://{tmp_path}/store"


def test_round_trip_and_pruning(spark, saved):
    e = Engine.from_store(spark, saved)
    assert e.df.count() == 100 and e.df.select("block_id").distinct().count() == 5
    assert {(f.name, f.type) for f in e.fields if f.name != "block_id"} == {("id", "int"), ("user", "string"), ("extra", "int"), ("at", "timestamp")}
    cat = store.catalog(spark, saved)
    assert {r.block_id for r in pruning.with_fields(cat, ["extra"]).collect()} == {3, 4}
    assert {r.block_id for r in pruning.with_types(cat, {"at": "timestamp"}).collect()} == {0, 1, 2}
    assert {r.block_id for r in pruning.with_range(cat, "id", 25, 45).collect()} == {1, 2}
    assert {r.block_id for r in pruning.with_range(cat, "at", "2023-01-05 00:00:00", "2023-01-09 00:00:00").collect()} == {2}
    row = pruning.strategy(cat, pruning.with_range(cat, "id", 25, 45)).first()
    assert (row.blocks, row.chosen, row.full_scan) == (5, 2, False)
    for text in ("extra > 90", "extra:70 OR user:u1", "NOT extra:70", "user:u1 AND extra:*", "id < 5"):
        assert sorted(r.id for r in e.pruned(text, cat).query(text).collect()) == sorted(r.id for r in e.query(text).collect())
    plan = e.pruned("extra > 90", cat).query("extra > 90").select("id")._jdf.queryExecution().executedPlan().toString()
    columns = {f.name: f"c{r.position}" for r, f in zip(store._listed(spark, saved), e.fields)}
    read = plan.split("ReadSchema")[1].split(">")[0]
    assert "block_id" in plan.split("PartitionFilters: [")[1].split("]")[0] and columns["extra"] + ":" in read and columns["user"] + ":" not in read
    for text, blocks in {"id:[25 TO 45]": {1, 2}, "id < 5": {0}, 'at >= "2023-01-05 00:00:00" AND at < "2023-01-05 12:00:00"': {2}, "user:u3 AND id = 61": {3}, "user:zed": set(),
                         "id:string: 5": set(), "user > u3": {0, 1, 2, 3, 4}, "NOT id > 20": {0, 1, 2, 3, 4}, "id > 90 OR extra:60": {3, 4}, "extra:*": {3, 4}}.items():
        chosen = pruning.select_blocks(cat, text)
        assert {r.block_id for r in chosen.collect()} == blocks, text
        if blocks != {0, 1, 2, 3, 4}:
            scan = pruning.prune(e.df, chosen)._jdf.queryExecution().executedPlan().toString()
            assert not blocks or "block_id" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert store.load(spark, saved, blocks=[0], columns=["id"]).count() == 20
    stats = store.compression_stats(spark, saved, ["id", "user"]).first()
    assert stats.records == 100 and stats.blocks == 5 and stats.ratio > 0


def test_pruning_of_negations(spark, saved):
    cat = store.catalog(spark, saved)
    plain = Engine.from_store(spark, saved)
    texts = ["NOT extra:*", "NOT (user:u1 AND extra:70)", "NOT (NOT extra:*)", "NOT (extra:* OR user:u1)", "NOT (extra:70 OR user:u1)", "NOT (extra != 70)",
             "extra != 70", "extra != 70 AND user:u1", "NOT (extra:70 AND NOT at:*)"]
    for e in (plain, Engine(plain.df, plain.fields, null_is_different=True)):
        for text in texts:
            want = sorted(r.id for r in e.query(text).collect())
            assert want and sorted(r.id for r in e.pruned(text, cat).query(text).collect()) == want, text
    assert plain.query("NOT extra:*").count() == 60
    assert pruning.select_blocks(cat, "NOT (extra:70 OR user:u1)").count() == 2  # a comparison is not false without its field
    # A name of several types: != is false where none is there.
    rows = [[{"a": 1}, {"a": "x"}], [{"b": 1}]]
    lines = spark.createDataFrame([(json.dumps(r), n) for n, part in enumerate(rows) for r in part], "value string, block_id long")
    e = Engine.from_json(lines, keep=["block_id"])
    blocks = pruning.block_catalog(e.df, [f for f in e.fields if f.name != "block_id"])
    for text in ("NOT (a != 1)", "NOT (a !~ x)", "a != 1", "NOT a:1"):
        assert sorted(map(str, e.pruned(text, blocks).query(text).collect())) == sorted(map(str, e.query(text).collect())), text


def test_rebuilt_lines(spark, saved, tmp_path):
    ndjson.write_lines(Engine.from_store(spark, saved).to_json(), f"file://{tmp_path}/out")
    got = [json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/out").collect()]
    assert sorted(got, key=lambda r: r["id"]) == records(100)


def test_blocks_follow_the_file(spark, tmp_path):
    write(tmp_path / "x.json", [{"i": i} for i in range(50)])
    df = ndjson.with_blocks(ndjson.read_lines(spark, str(tmp_path / "x.json")), 20)
    assert [r["count"] for r in df.groupBy("block_id").count().orderBy("block_id").collect()] == [20, 20, 10]
    assert ndjson.with_blocks(df.drop("block_id").limit(0), 20).count() == 0
    assert ndjson.read_lines(spark, str(tmp_path / "x.json"), limit=7).count() == 7


def test_stream_of_batches(spark, tmp_path):
    source, root = tmp_path / "in", f"file://{tmp_path}/store"
    write(source / "1.json", [{"id": i, "user": "a"} for i in range(5)])
    leaves = ingest.learn(spark.read.text(str(source)))
    more = ['{"id":1,"user":"b","new":1}', '{"id":"text","user":"b"}', "{bad", '{"id":2,"user":"b"}', '{"id":3,"user":"b","o":{}}', "[1]"]
    for n in (5, 11):
        ingest.ingest(spark, str(source), root, leaves, f"file://{tmp_path}/cp").awaitTermination()
        e = Engine.from_store(spark, root)
        assert e.df.count() == n
        (source / "2.json").write_text("\n".join(more) + "\n")
    assert {r[0] for r in e.df.select("block_id").distinct().collect()} == {0, 1}
    assert sorted(r[0] for r in e.df.where("_rest is not null").select("_rest").collect()) == sorted(m for m in more if m != more[3])
    assert e.query("user:b AND COUNT(*)").first()[0] == 4
    assert e.df.where("id = 1 and _rest like '%new%'").count() == 1
    cat = store.catalog(spark, root)
    assert pruning.with_range(cat, "id", 4, 9).count() == 1 and {r.block_id for r in pruning.select_blocks(cat, "user:b").collect()} == {1}
    # A batch that runs again takes the place of its block and of its catalog.
    df, fields = ingest.flattened(spark.createDataFrame([('{"id":7,"user":"z"}',)], "value string"), leaves)
    for _ in range(2):
        store.write_block(df, fields, root, 1)
    assert Engine.from_store(spark, root).df.count() == 6 and store.catalog(spark, root).where("block_id = 1 and name = 'id'").first().occurrences == 1


def test_blocks_with_fields_of_their_own(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    for n, rows in enumerate(([{"a": 1, "x": 5}], [{"a": 2, "y": "new"}])):
        write(tmp_path / f"{n}.json", rows)
        lines = ndjson.read_lines(spark, str(tmp_path / f"{n}.json")).selectExpr("value", f"{n}L as block_id")
        Engine.from_json(lines, keep=["block_id"]).save(root, mode="append")
    e = Engine.from_store(spark, root)
    assert {(f.name, f.type) for f in e.fields} == {("a", "int"), ("x", "int"), ("y", "string")}
    assert [r.a for r in e.query("y:new").collect()] == [2] and e.query("x:5 OR a:2").count() == 2
    assert [r.block_id for r in pruning.with_fields(store.catalog(spark, root), ["y"]).collect()] == [1]


def test_appends_catalogue_only_what_they_write(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    parts = [[{"a": 1, "User": "x"}], [{"a": "one", "user": "y"}], [{"a": 2.5, "User": "z"}]]
    for n, rows in enumerate(parts):
        write(tmp_path / f"{n}.json", rows)
        lines = ndjson.read_lines(spark, str(tmp_path / f"{n}.json")).selectExpr("value", f"{n // 2}L as block_id")
        Engine.from_json(lines, keep=["block_id"]).save(root, mode="append")
        assert spark.read.parquet(f"{root}/catalog").select("batch").distinct().count() == n + 1
    e = Engine.from_store(spark, root)
    assert [(f.name, f.type) for f in e.fields] == [("User", "string"), ("a", "int"), ("a", "string"), ("user", "string"), ("a", "double")]
    assert e.query("User:x").count() == 1 and e.query("user:y AND a:one").count() == 1 and e.query("a:double: 2.5").count() == 1 and e.query("a:1").count() == 1
    cat = store.catalog(spark, root)
    assert {(r.block_id, r.occurrences) for r in cat.where("name = 'User'").collect()} == {(0, 1), (1, 1)} and {r.block_id for r in pruning.select_blocks(cat, "a:double: 2.5").collect()} == {1}


def test_pruning_never_loses_a_match(spark, tmp_path):
    rng = random.Random(3)
    rows = [{"n": rng.choice([i, i / 2, f"t{i}"]), "s": f"{i % 13:02d}" + "long" * 30, "t": f"2024-01-{1 + i // 12:02d} 00:00:{i % 60:02d}"} | ({"x": i} if i % 40 < 9 else {}) for i in range(300)]
    write(tmp_path / "in.json", rows)
    e = Engine.from_files(spark, str(tmp_path / "in.json"), block_size=25)
    e.save(f"file://{tmp_path}/store", bloom=["s"])
    e, cat = Engine.from_store(spark, f"file://{tmp_path}/store"), store.catalog(spark, f"file://{tmp_path}/store")
    e, cat = Engine(e.df.persist(), e.fields), cat.persist()
    single = ["n > 200", "n:t7", "n <= 3.5", "n:[10 TO 20]", "x:*", "x >= 120", "s:\"" + rows[5]["s"] + "\"", "s < 03", "t:[\"2024-01-03 00:00:00\" TO \"2024-01-04\"]", "x != 5", "n:int: 8", "s ~ long"]
    texts = single + [f"{rng.choice(['', 'NOT '])}({a}) {rng.choice(['AND', 'OR'])} {rng.choice(['', 'NOT '])}({b})" for a, b in (rng.sample(single, 2) for _ in range(25))]
    pruned = 0
    for text in texts:
        for null_is_different in (False, True):
            engine = Engine(e.df, e.fields, null_is_different)
            want = sorted(r.t for r in engine.query(text).collect())
            assert sorted(r.t for r in engine.pruned(text, cat).query(text).collect()) == want, text
        chosen = pruning.select_blocks(cat, text)
        pruned += chosen is not None and chosen.count() < 12
    assert pruned >= 15


def test_native_times_prune(spark):
    df = spark.range(100).selectExpr("id", "timestamp_seconds(id * 86400) as at", "floor(id / 10) as block_id")
    e = Engine(df)
    cat = pruning.block_catalog(df, [f for f in e.fields if f.name != "block_id"])
    text = 'at:["1970-01-12" TO "1970-01-15"]'
    assert {r.block_id for r in pruning.select_blocks(cat, text).collect()} == {1} and e.pruned(text, cat).query(text).count() == e.query(text).count() == 4


def final_plan(df):
    """The plan as it was run, without what lies below a cached frame."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("InMemoryRelation")[0]


def catalogued(monkeypatch):
    """The plans by which catalogs are computed from here on."""
    plans, plain = [], store.block_catalog
    monkeypatch.setattr(store, "block_catalog", lambda *a: plans.append(final_plan(plain(*a))) or plain(*a))
    return plans


def test_a_store_is_catalogued_without_sorting_its_cells(spark, tmp_path, monkeypatch):
    plans = catalogued(monkeypatch)
    df = spark.range(0, 3000, 1, 6).selectExpr("id % 7 as block_id", "if(id % 7 = 3, null, id) as n", "concat('t', id) as s", "id > 4 as flag", "timestamp_seconds(id) as at", "id * 0.5D as d")
    Engine(df).save(f"file://{tmp_path}/store")
    assert len(plans) == 1 and "SortAggregate" in plans[0] and "Sort [" not in plans[0] and "Exchange" not in plans[0]
    want = set()
    for b in range(7):
        ids = range(b, 3000, 7)
        texts = sorted(f"t{i}" for i in ids)
        want |= {(b, "s", "string", len(ids), None, None, texts[0], texts[-1]), (b, "flag", "bool", len(ids), None, None, None, None),
                 (b, "at", "timestamp", len(ids), ids[0] * 1e6, ids[-1] * 1e6, None, None), (b, "d", "double", len(ids), ids[0] / 2, ids[-1] / 2, None, None)}
        want |= {(b, "n", "int", len(ids), float(ids[0]), float(ids[-1]), None, None)} if b != 3 else set()
    cat = store.catalog(spark, f"file://{tmp_path}/store")
    assert set(map(tuple, cat.collect())) == want and store.load(spark, f"file://{tmp_path}/store").count() == 3000


def test_a_batch_is_catalogued_without_sorting(spark, tmp_path, monkeypatch):
    plans, root = catalogued(monkeypatch), f"file://{tmp_path}/store"
    for number, low in ((4, 10), (9, 500)):
        df = spark.range(low, low + 90, 1, 3).selectExpr("id as n", "concat('t', id) as s", "cast(null as double) as d")
        store.write_block(df, Engine(df).fields, root, number)
    assert len(plans) == 2 and not any("Sort [" in p or "hashpartitioning" in p for p in plans)
    got = {tuple(r) for r in store.catalog(spark, root).collect()}
    assert got == {(4, "n", "int", 90, 10.0, 99.0, None, None), (4, "s", "string", 90, None, None, "t10", "t99"),
                   (9, "n", "int", 90, 500.0, 589.0, None, None), (9, "s", "string", 90, None, None, "t500", "t589")}
    empty = spark.range(0).selectExpr("id as n", "'x' as s", "cast(null as double) as d")
    store.write_block(empty, Engine(empty).fields, root, 11)
    assert store.catalog(spark, root).where("block_id = 11").count() == 0


def test_catalog_of_many_fields(spark, monkeypatch):
    monkeypatch.setattr(pruning, "WIDTH", 3, raising=False)
    df = spark.range(20).selectExpr("id % 2 as block_id", *[f"if(id >= {i}, id + {i}, null) as f{i}" for i in range(8)], "cast(null as bigint) as none")
    fields = [f for f in Engine(df).fields if f.name != "block_id"]
    got = {(r.block_id, r.name): (r.occurrences, r.low, r.high) for r in pruning.block_catalog(df, fields).collect()}
    assert got == {(b, f"f{i}"): (len(v), min(v) + i, max(v) + i) for b in (0, 1) for i in range(8) for v in [[x for x in range(b, 20, 2) if x >= i]]}
    assert not pruning.block_catalog(df.limit(0), fields).collect()


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "a"), ("2024-01-01 00:04:59", "a"), ("2024-01-01 00:05:00", "b")]
    spark.createDataFrame(rows, "t string, k string").selectExpr("cast(t as timestamp) t", "k").write.parquet(f"{tmp_path}/e")
    static = ingest.windowed_counts(spark.read.parquet(f"{tmp_path}/e"), "t", "k")
    assert sorted((r.k, r.n) for r in static.collect()) == [("a", 2), ("b", 1)]
    stream = spark.readStream.schema("t timestamp, k string").parquet(f"{tmp_path}/e")
    q = ingest.windowed_counts(stream, "t", "k").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.n) for r in spark.table("w").collect()) == [("a", 2), ("b", 1)]


def test_command_line(spark, saved):
    a = arguments().parse_args(["--data-dir", saved, "--field", "user", "--dict", "user", "--point", "id", "7", "--range", "id", "1", "3", "--aggregate", "SUM", "id", "--aggregate", "COUNT",
                                "--complex", "user:u1", "AND", "id", "<", "10", "--group", "user"])
    e = Engine.from_store(spark, saved)
    out = [answer(e, kind, args).collect() for kind, args in a.queries]
    assert out[0][0].exists and len(out[1]) == 5 and len(out[2]) == 1 and len(out[3]) == 3
    assert out[4][0][0] == sum(range(100)) and out[5][0][0] == 100 and len(out[6]) == 2 and len(out[7]) == 5
