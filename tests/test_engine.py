import json

import pytest
from pyspark.sql import functions as F

from loomlog import Engine
from loomlog.operators import catalog
from loomlog.operators.flatten import discover, extract, parse_json
from loomlog.plans.parser import QueryError, parse
from loomlog.plans.resolver import ResolveError
from loomlog.sources import ndjson

F1 = [
    {"user": "ann", "age": 25, "score": 95.5, "active": True, "ts": "2023-01-01T10:00:00Z", "msg": "user 7 logged in from 10.0.0.1"},
    {"user": "bob", "age": 30, "score": 88.0, "active": False, "ts": "2023-01-02T11:00:00Z", "msg": "user 8 logged in from 10.0.0.2"},
    {"user": "cho", "age": 35, "score": 91.25, "active": True, "ts": "2023-01-03T12:00:00Z", "msg": "disk full"},
    {"user": "ann", "age": 25, "score": 95.5, "active": True, "ts": "2023-01-01T10:00:00Z", "msg": "user 7 logged in from 10.0.0.1"},
    {"user": "dee", "age": -4, "active": False, "ts": "2023-01-05T14:00:00Z", "msg": "mail a@b.com sent"},
    {"user": "eve", "age": None, "score": 70.0, "ts": "2023-01-06T15:00:00Z", "msg": "ok"},
]


def lines(spark, rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


@pytest.fixture(scope="module")
def typed(spark):
    e = Engine.from_json(lines(spark, F1))
    return Engine(e.df.persist(), e.fields)


def test_fields(typed):
    assert {(f.name, f.type) for f in typed.fields} == {
        ("user", "string"), ("age", "int"), ("score", "double"), ("active", "bool"), ("ts", "timestamp"), ("msg", "logtype"), ("msg", "string"),
    }


@pytest.mark.parametrize(
    "text,n",
    [
        ("age >= 30", 2), ("age:[25 TO 30]", 3), ("NOT user:ann", 4), ("age != 25", 3), ("user:bob OR user:ann AND active:bool: true", 2),
        ("user:bob OR (user:ann AND active:bool: true)", 3), ("score = 95.5", 2), ("score > 90.0", 3), ("active:true", 3), ("active:false", 2),
        ('ts:"2023-01-01T10:00:00Z"', 2), ('ts:"2023-12-31T23:59:59Z"', 0), ('ts >= "2023-01-05T00:00:00Z"', 2), ("user:frank", 0), ("score:*", 5),
        ("msg:ok", 1), ('msg:"disk full"', 1), ("msg ~ logged", 3), ("NOT msg ~ logged", 3), ("msg !~ logged", 3), ('msg:"*full"', 1), ("msg:*", 6), ('user:"*n*"', 2),
        ('msg:template: "user * logged in from *.*.*.*"', 3), ("age:[30 TO 25]", 0), ("NOT age > 0", 1), ("age > 24.5 AND age < 30", 2), ("user:string: ann", 2),
        ('msg != "disk full"', 5), ("age <= -4", 1), ("active < true", 2),
    ],
)
def test_counts(typed, text, n):
    assert typed.query(text).count() == n


def test_metamorphic(typed):
    total = typed.df.count()
    for p in ("age > 25", "score < 91", "user:ann", "active:true", "msg ~ o"):
        column = typed.resolver.condition(parse(p))
        unknown = typed.df.where(column.isNull()).count()
        assert typed.query(p).count() + typed.query(f"NOT ({p})").count() + unknown == total
    assert typed.query("age:[25 TO 30]").count() == typed.query("age >= 25 AND age <= 30").count()


def test_aggregates(typed):
    def one(text):
        return tuple(typed.query(text).first())

    assert one("COUNT(*)") == (6,) and one("COUNT(age)") == (5,) and one("COUNT(score)") == (5,)
    assert one("SUM(age)") == (111.0,) and one("MIN(age)") == (-4,) and one("MAX(age)") == (35,) and one("AVG(age)") == (22.2,)
    assert one("SUM(score)") == (440.25,) and one("SUM(user)") == (None,)
    assert one("user:ann AND COUNT(*) AND MAX(score)") == (2, 95.5)
    groups = {r["user"]: r["sum_age"] for r in typed.query("SUM(age) GROUP BY user").collect()}
    assert groups == {"ann": 50.0, "bob": 30.0, "cho": 35.0, "dee": -4.0, "eve": None}
    assert sum(v or 0 for v in groups.values()) == 111
    assert {tuple(r) for r in typed.group(["active"]).collect()} == {(True, 3), (False, 2), (None, 1)}
    assert {tuple(r) for r in typed.group(["active"], drop_missing=True).collect()} == {(True, 3), (False, 2)}
    records = typed.group_records(["user"], sample=1).where("user = 'ann'").first()
    assert records["count"] == 2 and len(records["records"]) == 1


def test_all_negative_maximum(spark):
    e = Engine.from_json(lines(spark, [{"v": -5}, {"v": -3}, {"v": -9}]))
    assert e.query("MAX(v)").first()[0] == -3


def test_conflicts_nesting_and_malformed(spark):
    rows = ['{"a":1}', '{"a":"x"}', '{"a":{"b":2}}', '{"a.b":3}', '{"a":{"b":{"c":4}}}', '{"a":null}', "{bad", "[1]", "7", '{"a":9}x', '{"a":9}}', '{"a":9}]', '{"a":9},{"a":9}', '{"a":9},0]x', '{"a":9}{"a":9}', '"a":9}']
    good, bad = ndjson.split_malformed(lines(spark, rows))
    assert good.count() == 6 and bad.count() == 10
    e = Engine.from_json(lines(spark, rows))
    assert {(f.name, f.type) for f in e.fields} == {("a", "int"), ("a", "string"), ("~a.b", "int"), ("a.b", "int"), ("~a.b.c", "int")}
    found = discover(lines(spark, rows).select(parse_json(F.col("value")).alias("v")), "v")
    assert ("a", "null") in {(x.name, x.type) for x in found}
    assert e.query("a:1").count() == 1 and e.query("a:x").count() == 1 and e.query("a:*").count() == 2 and e.query("a:string: 1").count() == 0
    assert e.query("a.b:3").count() == 1 and e.query("~a.b:2").count() == 1 and e.query("a.*.c:4").count() == 1 and e.query("*.c:4").count() == 1
    back = sorted(json.dumps(json.loads(r.record), sort_keys=True) for r in e.to_json().collect())
    assert back == sorted(json.dumps(json.loads(r), sort_keys=True) for r in rows[:5] + ["{}"])


def test_names_that_spark_confuses(spark):
    rows = [{"User": 1, "user": 2, "x": 1, "x__int": 5}, {"x": "a", "USER": 3, "k y": 1, "t`k": 4}]
    e = Engine.from_json(lines(spark, rows))
    assert len({f.column.lower() for f in e.fields}) == len(e.fields) == 8
    assert e.query("user:2").count() == 1 and e.query("User:2").count() == 0 and e.query("USER:3").count() == 1
    assert e.query("x__int:5").count() == 1 and e.query("x:int: 1").count() == 1 and e.query("x:a").count() == 1
    assert e.point("t`k", "4").count() == 1 and e.point("k y", "1").count() == 1
    back = sorted(json.dumps(json.loads(r.record), sort_keys=True) for r in e.to_json().collect())
    assert back == sorted(json.dumps(r, sort_keys=True) for r in rows)


def test_keys_with_quotes(spark):
    keys = ["it's", 'q"q', "both'\"", "b\\s", "a?b", "x]y", ""]
    e = Engine.from_json(lines(spark, [{k: i, "n": {k: i}} for i, k in enumerate(keys)]))
    for i, k in enumerate(keys):
        assert e.point(k, str(i)).count() == 1 and e.point(f"~n.{k}", str(i)).count() == 1
    rows = lines(spark, [{k: None} for k in keys])
    assert all(r.exists for r in catalog.key_exists(rows, "value", keys).collect())


def test_nesting_without_limit(spark):
    deep = '{"k":' * 40 + "7" + "}" * 40
    e = Engine.from_json(lines(spark, [deep, '{"k":5,"e":{},"j":{"l":{"m":{"n":{"o":{"p":"x"}}}}}}']))
    kinds = {f.name: f.type for f in e.fields}
    assert kinds["~j.l.m.n.o.p"] == "string" and kinds["~" + ".".join("k" * 32)] == "object" and kinds["k"] == "int" and len(e.fields) == 3
    texts = [json.loads(r.record) for r in e.to_json().collect()]
    assert json.loads(deep) in texts


def test_objects_with_very_many_keys_stay_text(spark):
    rows = [{"id": i, "by": {f"key{i}-{j}": {"z": j} for j in range(20)}, "s": {"a": 1}} for i in range(30)]
    df = lines(spark, rows).select(parse_json(F.col("value")).alias("v"))
    found = {(x.name, x.type) for x in discover(df, "v", wide=50)}
    assert found == {("id", "int"), ("by", "object"), ("~s.a", "int")}
    assert {(x.name, x.type) for x in discover(df, "v", wide=2)} >= {("_record", "object")}


def test_codes_in_order(spark):
    df = spark.createDataFrame([(f"{i * 7919 % 5000:04d}" + "x" * (i % 90),) for i in range(5000)] + [(None,)], "v string").repartition(7)
    got = [(r.code, r.v) for r in catalog.numbered(df, "v").orderBy("code").collect()]
    assert [c for c, _ in got] == list(range(1, 5002)) and got[0][1] is None and [v for _, v in got[1:]] == sorted(v for _, v in got[1:])
    numbers = catalog.numbered(spark.range(1000).selectExpr("id * 1.5 as v"), "v", pieces=5).collect()
    assert all(r.v == (r.code - 1) * 1.5 for r in numbers) and catalog.numbered(df.limit(0), "v").count() == 0


def test_arrays(spark):
    rows = [{"t": ["x", "y"]}, {"t": []}, {"t": [{"k": 1}]}]
    text = Engine.from_json(lines(spark, rows))
    assert sorted(r[0] for r in text.df.collect()) == ['["x","y"]', "[]", '[{"k":1}]']
    wide = Engine.from_json(lines(spark, rows), structured=True)
    assert {(f.name, f.type) for f in wide.fields} >= {("t[0]", "string"), ("t[1]", "string")}
    assert any(f.name.endswith("t[0].k") and f.type == "int" for f in wide.fields)


def test_numbers(spark):
    rows = ['{"n":1}', '{"n":2.0}', '{"n":2.5}', '{"n":1e3}', '{"n":9223372036854775807}', '{"n":18446744073709551615}']
    e = Engine.from_json(lines(spark, rows))
    assert {(f.type) for f in e.fields} == {"int", "double"}
    ints = sorted(r[0] for r in e.df.select("n__int").collect() if r[0] is not None)
    doubles = sorted(r[0] for r in e.df.select("n__double").collect() if r[0] is not None)
    assert ints == [1, 9223372036854775807] and doubles == [2.0, 2.5, 1000.0, 18446744073709551615.0]


def test_errors(typed):
    for text in ("nothing:1", "age:abc", "active > 3", "age:string: 5"):
        with pytest.raises(ResolveError):
            typed.query(text)
    with pytest.raises(QueryError):
        typed.query("user:ann OR COUNT(*)")


def test_catalog(typed, spark):
    rows = {r.name: r for r in typed.field_exists(("age", "int"), ("age", "string"), "zzz").collect()[1:]}
    assert rows["age"].exists and not rows["age"].type_matches and rows["age"].actual_type == "int" and not rows["zzz"].exists
    assert {r.value for r in typed.browse("user").collect()} == {"ann", "bob", "cho", "dee", "eve"}
    assert {r.value for r in typed.browse("msg", templates=True).collect()} == {"user * logged in from *.*.*.*", "disk full", "mail * sent", "ok"}
    assert {(r.template, r.n) for r in typed.templates("msg").collect()} >= {("user * logged in from *.*.*.*", 3)}
    assert typed.lookup("user", "ann").first().found and not typed.lookup("user", "zed").first().found
    assert [tuple(r) for r in typed.dictionary("user").orderBy("code").collect()] == [(i + 1, u) for i, u in enumerate(["ann", "bob", "cho", "dee", "eve"])]
    texts = {r[k] for r in F1 for k in ("user", "ts", "msg")}
    assert {r.value for r in typed.browse("", scope="global").collect()} == texts
    stats = {r.name: r for r in typed.field_stats(["user", "age"]).collect()}
    assert (stats["user"].occurrences, stats["user"].distinct_values) == (6, 5) and stats["age"].occurrences == 5
    assert typed.field_order().count() == len(typed.fields) and abs(sum(r.percent for r in typed.type_stats().collect()) - 100) < 1e-9
    assert 0 < typed.missing_ratio().first().missing_ratio < 1
    single = Engine(spark.createDataFrame([("x",)] * 4, "c string")).field_stats().first()
    assert single.entropy == 0 and single.redundancy == 4


def test_rows(typed):
    assert typed.distinct().df.count() == 5
    assert typed.rebuild(required=["score"]).count() == 5
    out = [r.record for r in typed.rebuild(columns=["user"], descending=True, limit=2).collect()]
    assert out == ['{"user":"eve"}', '{"user":"dee"}']
    assert typed.project("user", "age").columns == ["user", "age"]
    assert typed.range("age", "2", "3", as_text=True).count() == 2  # "25", twice


def test_path_access(spark):
    df = lines(spark, [{"a": {"b": [{"c": 5}]}}]).select(parse_json(F.col("value")).alias("v"))
    assert df.select(extract("v", "a.b[0].c", "int")).first()[0] == 5


def test_templates_refill(spark):
    from loomlog.functions import templates as T

    df = lines(spark, ["user 12 at 10.0.0.1 mailed a.b@c.org", "none", "7", ""])
    made = T.refill(T.log_template(F.col("value")), T.log_variables(F.col("value")))
    assert df.where(made != F.col("value")).count() == 0
    row = spark.range(1).select(T.timestamp_template(F.lit("2023-03-28T04:00:00.040Z"))).first()[0]
    assert row == "*-*-*T*:*:*.*0Z"


def test_templates_refill_texts_with_stars(spark):
    from loomlog.functions import templates as T

    df = lines(spark, ["* 12 ** at 10.0.0.1 *mailed* a.b@c.org", "**", "7*8", "a*b@c.org*", "5 * 6 = 30", "none", ""])
    made = T.refill(T.log_template(F.col("value")), T.log_stars(F.col("value")))
    assert df.where(made.eqNullSafe(F.col("value"))).count() == df.count() == 7
    assert spark.sql("select cast(null as string) as value").select(made).first()[0] is None


@pytest.mark.parametrize(
    "text,kind",
    [
        ("2023-03-27 00:26:35.719 EDT", "timestamp"), ("2023-03-27 00:26:35 EDT", "timestamp"), ("2023-03-27 00:26:35", "timestamp"), ("2023-03-28T04:00:00.040Z", "timestamp"),
        ("2023-03-27T00:26:35Z", "timestamp"), ("2023/03/27 00:26:35", "timestamp"), ("2005.06.03", "timestamp"), ("2005-06-03-15.42.51.428563", "timestamp"),
        ("at 2023-03-27 00:26:35", "logtype"), ("word", "string"), ("", "string"),
    ],
)
def test_detection(spark, text, kind):
    from loomlog.functions.detect import string_type

    assert spark.range(1).select(string_type(F.lit(text))).first()[0] == kind


def test_plans_push_down(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id % 7 as string) as name", "id * 1.5 as value").write.parquet(f"{tmp_path}/t")
    e = Engine(spark.read.parquet(f"{tmp_path}/t"))
    plan = e.query("name:3 AND id > 50").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), IsNotNull(name)" in plan.replace("IsNotNull(name), IsNotNull(id)", "IsNotNull(id), IsNotNull(name)") and "value" not in plan
    assert "Python" not in plan


def test_key_exists(spark):
    rows = lines(spark, ['{"k":null}', '{"j":1}'])
    assert {tuple(r) for r in catalog.key_exists(rows, "value", ["k", "j", "z"]).collect()} == {("k", True), ("j", True), ("z", False)}


def test_named_cache(spark):
    from loomlog.operators.caching import NamedCache

    cache = NamedCache(capacity=2)
    frames = {n: spark.range(i).withColumnRenamed("id", n) for i, n in enumerate("abc")}
    cache.put_all({n: frames[n] for n in "ab"})
    assert cache.get("a").count() == 0 and cache.get("z") is None
    cache.put("c", frames["c"])
    assert "b" not in cache and set(cache.get_all("abc")) == {"a", "c"} and not frames["b"].storageLevel.useMemory
    cache.warm()
    row = cache.stats(spark).first()
    assert (row.kept, row.hits, row.misses, row.evictions) == (2, 3, 2, 1)
    assert cache.remove("a") and not cache.remove("a")
    cache.clear()
    assert "c" not in cache and not frames["c"].storageLevel.useMemory


def test_analysis_and_cache(typed):
    found = typed.analyse("age > 3 AND (user:ann OR user:bob) GROUP BY msg")
    assert found["fields"] == {"age": ["int"], "msg": ["logtype", "string"], "user": ["string"]}
    assert found["required"] == ["age", "user"] and found["predicates"] == 3
    kept = typed.cache()
    assert kept.point("age", "25", as_text=True).count() == 2
    assert kept.df.storageLevel.useMemory
