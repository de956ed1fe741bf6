"""Registered queries of the engine, one or more for each operator, and their SQL.

Every query runs over its whole table. Sums and averages are rounded to two digits and times are microseconds, so that both
engines give the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import detect, templates, text
from .operators import catalog, pruning, relational
from .operators.flatten import discover, extract, parse_json
from .session import work_folder
from .sources import ndjson, store
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str) -> Callable[[Query], Query]:
    def wrap(query: Query) -> Query:
        QUERIES[name] = query
        ORACLE_SQL[name] = sql
        return query

    return wrap


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(read(spark, sf_dir, "events"))


def events_json(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine.from_dataframe(read(spark, sf_dir, "events"), json=["props"])


def shown(df: DataFrame) -> DataFrame:
    """Event rows with their time as microseconds."""
    return df.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "user_id", "event_type", "value", "props")


EVENT = "event_id, epoch_us(ts) AS ts_us, user_id, event_type, value, props"


def _filter(name: str, text: str, where: str) -> None:
    register(name, f"SELECT {EVENT} FROM events WHERE {where}")(lambda s, d: shown(events(s, d).query(text)))


# --- filters in the query language -------------------------------------------------------------------

FLAGSHIP = "(event_type:error OR event_type:purchase) AND value > 10"

_filter("point_string", "event_type:error", "event_type = 'error'")
_filter("point_int", "user_id:8", "user_id = 8")
_filter("point_equals_sign", "event_type = click", "event_type = 'click'")
_filter("range_int", "user_id:[10 TO 20]", "user_id BETWEEN 10 AND 20")
_filter("range_double", "value:[10.5 TO 20]", "value BETWEEN 10.5 AND 20")
_filter("range_string", "event_type:[click TO purchase]", "event_type BETWEEN 'click' AND 'purchase'")
_filter("range_reversed", "user_id:[20 TO 10]", "user_id BETWEEN 20 AND 10")
_filter("cmp_gt", "value > 50", "value > 50")
_filter("cmp_ge", "user_id >= 50", "user_id >= 50")
_filter("cmp_lt", "value < 1.5", "value < 1.5")
_filter("cmp_le", "user_id <= 5", "user_id <= 5")
_filter("cmp_ne", "event_type != click", "event_type <> 'click'")
_filter("cmp_string", "event_type > login", "event_type > 'login'")
_filter("exists_row", "props:*", "props IS NOT NULL")
_filter("wildcard_match", 'event_type:"p*e"', "event_type LIKE 'p%e'")
_filter("contains", "event_type ~ c", "contains(event_type, 'c')")
_filter("not_contains", "event_type !~ c", "NOT contains(event_type, 'c')")
_filter("bool_and", "event_type:click AND user_id < 30", "event_type = 'click' AND user_id < 30")
_filter("bool_or", "event_type:click OR user_id < 3", "event_type = 'click' OR user_id < 3")
_filter("bool_not", "NOT event_type:click", "NOT event_type = 'click'")
_filter("bool_paren", FLAGSHIP, "(event_type = 'error' OR event_type = 'purchase') AND value > 10")
_filter(
    "bool_precedence", "event_type:error OR event_type:click AND value > 10", "(event_type = 'error' OR event_type = 'click') AND value > 10"
)
_filter("typed_predicate", "user_id:int: 12", "user_id = 12")
_filter("dict_predicate", "event_type:dict: click", "event_type = 'click'")
_filter("cmp_glued", "value>99 OR user_id<=1", "value > 99 OR user_id <= 1")


@register("range_ts", f"SELECT {EVENT} FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'")
def range_ts(spark, sf_dir):
    return shown(events(spark, sf_dir).query('ts:["2024-01-02 00:00:00" TO "2024-01-20 12:00:00"]'))


@register("range_as_text", f"SELECT {EVENT} FROM events WHERE CAST(user_id AS VARCHAR) BETWEEN '10' AND '2'")
def range_as_text(spark, sf_dir):
    return shown(events(spark, sf_dir).range("user_id", "10", "2", as_text=True))


@register("point_as_text", f"SELECT {EVENT} FROM events WHERE CAST(user_id AS VARCHAR) = '8'")
def point_as_text(spark, sf_dir):
    return shown(events(spark, sf_dir).point("user_id", "8", as_text=True))


@register("null_is_different", "SELECT doc_id, lang FROM documents WHERE lang IS DISTINCT FROM 'en'")
def null_is_different(spark, sf_dir):
    return Engine(read(spark, sf_dir, "documents").select("doc_id", "lang"), null_is_different=True).query("lang != en")


@register("json_path_predicate", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events WHERE CAST(props->>'k' AS BIGINT) > 50")
def json_path_predicate(spark, sf_dir):
    return events_json(spark, sf_dir).query("props.k:int > 50").select("event_id", F.col("`props.k`").alias("k"))


@register("path_wildcard", "SELECT event_id FROM events WHERE CAST(props->>'k' AS BIGINT) = 7")
def path_wildcard(spark, sf_dir):
    return events_json(spark, sf_dir).query("props.*: 7").select("event_id")


def polymorphic(spark: SparkSession, sf_dir: str) -> Engine:
    """Records whose field ``x`` is a number in even rows and a string in odd ones."""
    x = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("user_id").alias("x")))).otherwise(F.to_json(F.struct(F.col("event_type").alias("x"))))
    line = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(","), F.substring(x, F.lit(2), F.length(x) - 1))
    return Engine.from_json(read(spark, sf_dir, "events").select(line.alias("value")))


@register("polymorphic_any", "SELECT event_id AS id FROM events WHERE (event_id % 2 = 0 AND user_id >= 50) OR (event_id % 2 = 1 AND event_type >= '50')")
def polymorphic_any(spark, sf_dir):
    return polymorphic(spark, sf_dir).query("x >= 50").select("id")


@register("polymorphic_hint", "SELECT event_id AS id FROM events WHERE event_id % 2 = 0 AND user_id = 7")
def polymorphic_hint(spark, sf_dir):
    return polymorphic(spark, sf_dir).query("x:int: 7").select("id")


@register("polymorphic_not", "SELECT event_id AS id FROM events WHERE NOT (event_id % 2 = 1 AND event_type = 'click')")
def polymorphic_not(spark, sf_dir):
    return polymorphic(spark, sf_dir).query("NOT x:click").select("id")


LOG_PATTERN = templates.LOG_VARIABLE.replace("'", "''")


@register("template_query", f"SELECT conv_id, turn FROM conversations WHERE regexp_replace(text, '{LOG_PATTERN}', '*', 'g') = 'The *.'")
def template_query(spark, sf_dir):
    return Engine(read(spark, sf_dir, "conversations")).query('text:template: "The *."').select("conv_id", "turn")


# --- catalog -------------------------------------------------------------------------------------------


_TYPES = "CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp' ELSE 'int' END"


@register(
    "field_exists",
    f"""WITH f AS (SELECT column_name AS name, {_TYPES} AS type, CAST(row_number() OVER () - 1 AS INTEGER) AS position FROM (DESCRIBE events)),
    a AS (SELECT * FROM (VALUES ('event_type', 'string'), ('value', 'int'), ('absent', NULL)) AS t(name, expected))
    SELECT a.name, f.name IS NOT NULL AS "exists", coalesce(f.type = coalesce(expected, f.type), false) AS type_matches, f.type AS actual_type, position FROM a LEFT JOIN f USING (name)""",
)
def field_exists(spark, sf_dir):
    return events(spark, sf_dir).field_exists(("event_type", "string"), ("value", "int"), "absent")


@register("json_field_exists", """SELECT 'k' AS name, coalesce(bool_or(json_exists(props, '$.k')), false) AS "exists" FROM events
    UNION ALL SELECT 'zz', coalesce(bool_or(json_exists(props, '$.zz')), false) FROM events""")
def json_field_exists(spark, sf_dir):
    return catalog.key_exists(read(spark, sf_dir, "events"), "props", ["k", "zz"])


@register("json_catalog", "SELECT 'k' AS name, 'int' AS type, count(*) AS occurrences FROM events WHERE json_type(props, '$.k') IN ('BIGINT', 'UBIGINT')")
def json_catalog(spark, sf_dir):
    found = discover(read(spark, sf_dir, "events").select(parse_json(F.col("props")).alias("v")), "v")
    return spark.createDataFrame([(x.name, x.type, x.occurrences) for x in found], "name string, type string, occurrences bigint")


@register("json_key_counts", "SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def json_key_counts(spark, sf_dir):
    return catalog.key_counts(read(spark, sf_dir, "events"), "props")


@register("dict_browse", "SELECT DISTINCT event_type AS value FROM events WHERE event_type IS NOT NULL")
def dict_browse(spark, sf_dir):
    return events(spark, sf_dir).browse("event_type")


@register("dict_templates", f"SELECT DISTINCT regexp_replace(text, '{LOG_PATTERN}', '*', 'g') AS value FROM conversations WHERE text IS NOT NULL")
def dict_templates(spark, sf_dir):
    return Engine(read(spark, sf_dir, "conversations")).browse("text", templates=True)


@register("dict_global", "SELECT event_type AS value FROM events UNION SELECT props FROM events")
def dict_global(spark, sf_dir):
    return events(spark, sf_dir).browse("", scope="global")


@register("dict_lookup", """SELECT 'click' AS value, count(*) > 0 AS found FROM events WHERE event_type = 'click'
    UNION ALL SELECT 'nothing', count(*) > 0 FROM events WHERE event_type = 'nothing'""")
def dict_lookup(spark, sf_dir):
    e = events(spark, sf_dir)
    hit, miss = (e.lookup("event_type", v).select(F.lit(v).alias("value"), "found") for v in ("click", "nothing"))
    return hit.unionByName(miss)


@register("dict_codes", "SELECT row_number() OVER (ORDER BY value) AS code, value FROM (SELECT DISTINCT props AS value FROM events WHERE props IS NOT NULL)")
def dict_codes(spark, sf_dir):
    return events(spark, sf_dir).dictionary("props")


@register("dict_point", "SELECT code, value FROM (SELECT row_number() OVER (ORDER BY value) AS code, value FROM (SELECT DISTINCT event_type AS value FROM events)) WHERE code = 2")
def dict_point(spark, sf_dir):
    return events(spark, sf_dir).dictionary("event_type").where("code = 2")


@register("log_template_count", f"SELECT regexp_replace(text, '{LOG_PATTERN}', '*', 'g') AS template, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def log_template_count(spark, sf_dir):
    return Engine(read(spark, sf_dir, "conversations")).templates("text")


_CELLS = """c AS (SELECT 'user_id' AS name, 'int' AS type, CAST(user_id AS VARCHAR) AS value FROM events
  UNION ALL SELECT 'event_type', 'string', event_type FROM events UNION ALL SELECT 'props', 'string', props FROM events),
v AS (SELECT name, type, value, count(*) AS n FROM c WHERE value IS NOT NULL GROUP BY ALL),
t AS (SELECT count(*) AS records FROM events),
s AS (SELECT name, type, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS distinct_values, sum(n * log2(n)) AS nlogn FROM v GROUP BY ALL)"""
STAT_FIELDS = ["user_id", "event_type", "props"]


@register("field_stats", f"WITH {_CELLS} SELECT name, type, occurrences, distinct_values, round(occurrences / records, 6) AS frequency, round(distinct_values / occurrences, 6) AS uniqueness FROM s, t")
def field_stats(spark, sf_dir):
    stats = events(spark, sf_dir).field_stats(STAT_FIELDS)
    return stats.select("name", "type", "occurrences", "distinct_values", F.round("frequency", 6).alias("frequency"), F.round("uniqueness", 6).alias("uniqueness"))


@register("field_entropy", f"WITH {_CELLS} SELECT name, round(log2(occurrences) - nlogn / occurrences, 4) AS entropy FROM s")
def field_entropy(spark, sf_dir):
    return events(spark, sf_dir).field_stats(STAT_FIELDS).select("name", F.round("entropy", 4).alias("entropy"))


@register(
    "field_groups_abc",
    f"""WITH {_CELLS}, g AS (SELECT name, type, distinct_values, occurrences / records AS frequency,
      CASE WHEN distinct_values / occurrences >= 0.95 THEN 'C' WHEN occurrences / records > 0.8 AND distinct_values = 1 THEN 'A'
           WHEN occurrences / records > 0.8 THEN 'B' ELSE 'C' END AS field_group FROM s, t)
    SELECT name, field_group, CAST(row_number() OVER (PARTITION BY field_group ORDER BY
      CASE WHEN field_group = 'B' THEN CASE type WHEN 'string' THEN 0 ELSE 1 END END, CASE WHEN field_group = 'B' THEN distinct_values END,
      CASE WHEN field_group <> 'B' THEN frequency END DESC, name) AS INTEGER) AS position FROM g""",
)
def field_groups_abc(spark, sf_dir):
    return catalog.field_order(events(spark, sf_dir).field_stats(STAT_FIELDS)).select("name", "field_group", "position")


@register(
    "type_stats",
    f"""WITH {_CELLS} SELECT type, count(*) AS fields, CAST(sum(occurrences) AS BIGINT) AS occurrences, CAST(sum(distinct_values) AS BIGINT) AS distinct_values,
    round(100.0 * sum(occurrences) / (SELECT sum(occurrences) FROM s), 4) AS percent FROM s GROUP BY type""",
)
def type_stats(spark, sf_dir):
    return catalog.type_stats(events(spark, sf_dir).field_stats(STAT_FIELDS)).withColumn("percent", F.round("percent", 4))


@register("top_fields", f"WITH {_CELLS} SELECT name, type, occurrences, distinct_values FROM s ORDER BY occurrences DESC, name, type LIMIT 20")
def top_fields(spark, sf_dir):
    return catalog.top_fields(events(spark, sf_dir).field_stats(STAT_FIELDS))


@register("overall_indexes", f"WITH {_CELLS} SELECT round(sum(occurrences) / (any_value(records) * count(*)), 6) AS fi, round(sum(distinct_values / occurrences), 6) AS ui FROM s, t")
def overall_indexes(spark, sf_dir):
    e = events(spark, sf_dir)
    out = catalog.overall_indexes(e.df, e.field_stats(STAT_FIELDS))
    return out.select(F.round("fi", 6).alias("fi"), F.round("ui", 6).alias("ui"))


@register(
    "missing_ratio",
    """SELECT round(sum(CASE WHEN d.text IS NULL THEN 1 ELSE 0 END + CASE WHEN l.quality IS NULL THEN 1 ELSE 0 END) / (count(*) * 2), 6) AS missing_ratio,
    sum(CASE WHEN d.text IS NULL THEN 1 ELSE 0 END + CASE WHEN l.quality IS NULL THEN 1 ELSE 0 END) / (count(*) * 2) < 0.05 AS appropriate
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def missing_ratio(spark, sf_dir):
    df = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left").select("text", "quality")
    return Engine(df).missing_ratio().withColumn("missing_ratio", F.round("missing_ratio", 6))


def blocked_events(spark: SparkSession, sf_dir: str) -> Engine:
    df = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.floor(F.col("event_id") / 1000).cast("bigint").alias("block_id"))
    return Engine(df)


@register(
    "block_stats",
    """SELECT CAST(event_id // 1000 AS BIGINT) AS block_id, count(*) AS records,
    CAST(sum(strlen(CAST(to_json({event_id: event_id, user_id: user_id, event_type: event_type}) AS VARCHAR))) AS BIGINT) AS json_bytes FROM events GROUP BY 1""",
)
def block_stats(spark, sf_dir):
    return blocked_events(spark, sf_dir).block_stats().select("block_id", "records", "json_bytes")


# --- aggregates ------------------------------------------------------------------------------------------


@register("count_star", "SELECT count(*) AS count FROM events")
def count_star(spark, sf_dir):
    return events(spark, sf_dir).query("COUNT(*)")


@register("count_empty_parens", "SELECT count(*) AS count FROM events")
def count_empty_parens(spark, sf_dir):
    return events(spark, sf_dir).query("COUNT()")


@register("count_field", "SELECT count(quality) AS count_quality FROM documents LEFT JOIN labels USING (doc_id)")
def count_field(spark, sf_dir):
    return Engine(read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")).aggregate("COUNT", "quality")


@register("count_not_empty", "SELECT count(text) FILTER (WHERE text <> '') AS count_text FROM documents")
def count_not_empty(spark, sf_dir):
    return Engine(read(spark, sf_dir, "documents")).aggregate("COUNT", "text", skip_empty=True)


def _aggregate(function: str) -> None:
    f = function.lower()
    sql = f"SELECT round(CAST({f}(value) AS DOUBLE), 2) AS {f}_value FROM events"
    register(f"agg_{f}", sql)(lambda s, d: events(s, d).query(f"{function}(value)").select(F.round(f"{f}_value", 2).alias(f"{f}_value")))


for _f in ("SUM", "AVG", "MIN", "MAX"):
    _aggregate(_f)


@register("agg_text_numbers", "SELECT round(CAST(sum(TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE)) AS DOUBLE), 2) AS sum_p FROM orders")
def agg_text_numbers(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("p"))
    return Engine(df).query("SUM(p)").select(F.round("sum_p", 2).alias("sum_p"))


@register("agg_not_numeric", "SELECT CAST(NULL AS DOUBLE) AS sum_event_type")
def agg_not_numeric(spark, sf_dir):
    return events(spark, sf_dir).query("SUM(event_type)")


@register("agg_filtered", "SELECT max(user_id) AS max_user_id, count(*) AS count FROM events WHERE event_type = 'click' AND value > 10")
def agg_filtered(spark, sf_dir):
    return events(spark, sf_dir).query("event_type:click AND value > 10 AND MAX(user_id) AND COUNT(*)")


# --- groups ------------------------------------------------------------------------------------------------


@register("group_count_1", "SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def group_count_1(spark, sf_dir):
    return events(spark, sf_dir).query("COUNT(*) GROUP BY event_type")


@register("group_count_2", "SELECT event_type, user_id, count(*) AS count FROM events GROUP BY 1, 2")
def group_count_2(spark, sf_dir):
    return events(spark, sf_dir).group(["event_type", "user_id"])


@register("group_where", "SELECT user_id, count(*) AS count FROM events WHERE event_type = 'click' GROUP BY 1")
def group_where(spark, sf_dir):
    return events(spark, sf_dir).query("event_type:click GROUP BY user_id COUNT(*)")


@register("group_json_field", "SELECT CAST(props->>'k' AS BIGINT) AS k, count(*) AS count FROM events GROUP BY 1")
def group_json_field(spark, sf_dir):
    return events_json(spark, sf_dir).group(["props.k"]).withColumnRenamed("props.k", "k")


@register("group_missing_kept", "SELECT quality, count(*) AS count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def group_missing_kept(spark, sf_dir):
    return Engine(read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")).group(["quality"])


@register("group_missing_dropped", "SELECT quality, count(*) AS count FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1")
def group_missing_dropped(spark, sf_dir):
    return Engine(read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")).group(["quality"], drop_missing=True)


_RECORD = "CAST(to_json({event_id: event_id, user_id: user_id, event_type: event_type}) AS VARCHAR)"


@register(
    "group_records",
    f"""WITH r AS (SELECT user_id, {_RECORD} AS record FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY record) AS i, count(*) OVER (PARTITION BY user_id) AS c FROM r)
    SELECT user_id, string_agg(record, ';' ORDER BY record) AS records, any_value(c) AS count FROM n WHERE i <= 5 GROUP BY 1""",
)
def group_records(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return Engine(df).group_records(["user_id"]).withColumn("records", F.array_join("records", ";"))


@register("group_members", f"SELECT user_id, {_RECORD} AS record FROM events")
def group_members(spark, sf_dir):
    e = Engine(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"))
    return relational.group_rows(e.df, e.resolver, ["user_id"])


@register(
    "grouped_agg_multi",
    """SELECT event_type, count(value) AS count_value, round(sum(value), 2) AS sum_value, round(avg(value), 2) AS avg_value,
    min(user_id) AS min_user_id, max(value) AS max_value FROM events GROUP BY 1""",
)
def grouped_agg_multi(spark, sf_dir):
    out = events(spark, sf_dir).query("COUNT(value) AND SUM(value) AND AVG(value) AND MIN(user_id) AND MAX(value) GROUP BY event_type")
    return out.withColumn("sum_value", F.round("sum_value", 2)).withColumn("avg_value", F.round("avg_value", 2))


@register("grouped_agg_where", "SELECT user_id, event_type, max(value) AS max_value FROM events WHERE value < 50 GROUP BY 1, 2")
def grouped_agg_where(spark, sf_dir):
    return events(spark, sf_dir).group(["user_id", "event_type"], [("MAX", "value")], where="value < 50")


# --- JSON ----------------------------------------------------------------------------------------------------


@register("flatten_json", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def flatten_json(spark, sf_dir):
    return events_json(spark, sf_dir).df.select("event_id", F.col("`props.k`").alias("k"))


def nested(spark: SparkSession, sf_dir: str) -> Engine:
    line = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("id"),
            F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_custkey").alias("key")).alias("cust")).alias("o"),
            F.col("o_orderstatus").alias("o.status"),
        )
    )
    return Engine.from_json(read(spark, sf_dir, "orders").select(line.alias("value")))


@register("flatten_nested", "SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS nested_status, o_orderstatus AS literal_status FROM orders")
def flatten_nested(spark, sf_dir):
    df = nested(spark, sf_dir).df
    return df.select("id", F.col("`~o.cust.key`").alias("cust"), F.col("`~o.status`").alias("nested_status"), F.col("`o.status`").alias("literal_status"))


@register("nested_predicate", "SELECT o_orderkey AS id FROM orders WHERE o_custkey < 100 AND o_orderstatus = 'O'")
def nested_predicate(spark, sf_dir):
    return nested(spark, sf_dir).query("o.cust.key < 100 AND ~o.status:O").select("id")


@register("nested_round_trip", """SELECT '{"id":' || o_orderkey || ',"o":{"cust":{"key":' || o_custkey || '},"status":"' || o_orderstatus || '"},"o.status":"' || o_orderstatus || '"}' AS record FROM orders""")
def nested_round_trip(spark, sf_dir):
    e = nested(spark, sf_dir)
    order = ["id", "~o.cust.key", "~o.status", "o.status"]
    return Engine(e.df, sorted(e.fields, key=lambda f: order.index(f.name))).to_json()


def arrays(spark: SparkSession, sf_dir: str, structured: bool) -> Engine:
    line = F.to_json(F.struct(F.col("vec_id").alias("id"), F.array(F.col("label").cast("bigint"), F.col("vec_id")).alias("t")))
    return Engine.from_json(read(spark, sf_dir, "embeddings").select(line.alias("value")), structured=structured)


@register("array_text", "SELECT vec_id AS id, '[' || label || ',' || vec_id || ']' AS t FROM embeddings")
def array_text(spark, sf_dir):
    return arrays(spark, sf_dir, False).df.select("id", "t")


@register("array_explode", "SELECT vec_id AS id, CAST(label AS BIGINT) AS t0, vec_id AS t1 FROM embeddings")
def array_explode(spark, sf_dir):
    return arrays(spark, sf_dir, True).df.select("id", F.col("`t[0]`").alias("t0"), F.col("`t[1]`").alias("t1"))


@register("path_access", "SELECT vec_id, CAST(label AS BIGINT) AS first FROM embeddings")
def path_access(spark, sf_dir):
    line = F.to_json(F.struct(F.struct(F.array(F.col("label").cast("bigint")).alias("b")).alias("a")))
    df = read(spark, sf_dir, "embeddings").select("vec_id", parse_json(line).alias("v"))
    return df.select("vec_id", extract("v", "a.b[0]", "bigint").alias("first"))


@register(
    "malformed_lines",
    """WITH l AS (SELECT text AS value FROM documents UNION ALL SELECT props FROM events UNION ALL SELECT props || 'x' FROM events)
    SELECT count(*) FILTER (WHERE o) AS records, count(*) FILTER (WHERE NOT o) AS malformed
    FROM (SELECT CASE WHEN json_valid(value) THEN json_type(value) = 'OBJECT' ELSE false END AS o FROM l WHERE value IS NOT NULL)""",
)
def malformed_lines(spark, sf_dir):
    props = read(spark, sf_dir, "events").select("props")
    lines = read(spark, sf_dir, "documents").select(F.col("text").alias("value")).union(props).union(props.select(F.concat("props", F.lit("x"))))
    good, bad = ndjson.split_malformed(lines.where("value is not null"))
    counted = good.select(F.lit(1).alias("good"), F.lit(0).alias("bad")).union(bad.select(F.lit(0), F.lit(1)))
    return counted.agg(F.sum("good").cast("bigint").alias("records"), F.sum("bad").cast("bigint").alias("malformed"))


# --- types and templates ------------------------------------------------------------------------------------

_TS_FULL = "|".join(detect.TIMESTAMPS + detect.EXTENDED_TIMESTAMPS)


@register(
    "type_detect",
    f"""WITH t AS (SELECT text AS v FROM documents UNION ALL SELECT event_type FROM events UNION ALL SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') FROM events)
    SELECT CASE WHEN regexp_full_match(v, '{_TS_FULL}') THEN 'timestamp' WHEN contains(v, ' ') THEN 'logtype' ELSE 'string' END AS type, count(*) AS n
    FROM t WHERE v IS NOT NULL GROUP BY 1""",
)
def type_detect(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    values = read(spark, sf_dir, "documents").select(F.col("text").alias("v")).union(e.select("event_type"))
    values = values.union(e.select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return values.where("v is not null").groupBy(detect.string_type(F.col("v")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


_TS_TEXT = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


@register("ts_template", f"SELECT regexp_replace({_TS_TEXT}, '\\d{{4}}|\\d{{2}}', '*', 'g') AS template, count(*) AS n FROM events GROUP BY 1")
def ts_template(spark, sf_dir):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return read(spark, sf_dir, "events").groupBy(templates.timestamp_template(text).alias("template")).agg(F.count(F.lit(1)).alias("n"))


@register("ts_variables", f"SELECT event_id, array_to_string(regexp_extract_all({_TS_TEXT}, '\\d{{4}}|\\d{{2}}'), ',') AS vars FROM events")
def ts_variables(spark, sf_dir):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return read(spark, sf_dir, "events").select("event_id", F.array_join(templates.timestamp_variables(text), ",").alias("vars"))


@register("log_template", f"SELECT doc_id, regexp_replace(text, '{LOG_PATTERN}', '*', 'g') AS template, array_to_string(regexp_extract_all(text, '{LOG_PATTERN}'), ',') AS vars FROM documents")
def log_template(spark, sf_dir):
    e = Engine(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return catalog.template_variables(e.df, e.resolver, "text", ["doc_id"]).select("doc_id", "template", F.array_join("variables", ",").alias("vars"))


@register("template_refill", "SELECT doc_id, text AS refilled FROM documents")
def template_refill(spark, sf_dir):
    df = read(spark, sf_dir, "documents")
    return df.select("doc_id", templates.refill(templates.log_template(F.col("text")), templates.log_stars(F.col("text"))).alias("refilled"))


@register("epoch_text", "SELECT event_id, strftime(make_timestamp(user_id * 86400000000), '%Y-%m-%d %H:%M:%S') AS at FROM events")
def epoch_text(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", text.epoch_text(F.col("user_id") * 86400).alias("at"))


@register("aggregate_text", "SELECT 'SUM(user_id) = ' || printf('%.6f', CAST(sum(user_id) AS DOUBLE)) AS answer FROM events")
def aggregate_text(spark, sf_dir):
    out = events(spark, sf_dir).query("SUM(user_id)")
    return out.select(text.aggregate_text("SUM(user_id)", F.col("sum_user_id")).alias("answer"))


# --- rows and blocks ------------------------------------------------------------------------------------------


@register("distinct_records", "SELECT DISTINCT event_type, user_id FROM events")
def distinct_records(spark, sf_dir):
    return Engine(read(spark, sf_dir, "events").select("event_type", "user_id")).distinct().df


@register("block_distinct", "SELECT DISTINCT CAST(event_id // 1000 AS BIGINT) AS block_id, event_type, user_id FROM events")
def block_distinct(spark, sf_dir):
    df = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 1000).cast("bigint").alias("block_id"), "event_type", "user_id")
    return Engine(df).distinct(by_block=True).df


@register("rebuild_json", f"SELECT {_RECORD} AS record FROM events")
def rebuild_json(spark, sf_dir):
    return Engine(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")).rebuild()


@register("required_fields", """SELECT CAST(to_json({doc_id: doc_id, quality: quality}) AS VARCHAR) AS record FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL""")
def required_fields(spark, sf_dir):
    df = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality")
    return Engine(df).rebuild(required=["quality"])


@register("limit_sorted", f"SELECT {_RECORD} AS record FROM events ORDER BY record DESC LIMIT 1000")
def limit_sorted(spark, sf_dir):
    return Engine(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")).rebuild(descending=True, limit=1000)


@register("project_fields", "SELECT event_id, event_type FROM events")
def project_fields(spark, sf_dir):
    return events(spark, sf_dir).project("event_id", "event_type")


# --- stores -----------------------------------------------------------------------------------------------------

_STORES: dict[tuple[str, str], str] = {}
_BLOCKED = "SELECT event_id, user_id, event_type, value, ts, CAST(event_id // 1000 AS BIGINT) AS block_id FROM events"


def event_store(spark: SparkSession, sf_dir: str) -> str:
    """The root of a store of the events, written once a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORES:
        root = work_folder(spark, "events")
        df = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts", F.floor(F.col("event_id") / 1000).cast("bigint").alias("block_id"))
        Engine(df).save(root, bloom=["event_type"])
        _STORES[key] = root
    return _STORES[key]


def stored_events(spark: SparkSession, sf_dir: str) -> tuple[Engine, DataFrame]:
    root = event_store(spark, sf_dir)
    return Engine.from_store(spark, root), store.catalog(spark, root)


def _pruned(name: str, text: str, where: str) -> None:
    @register(name, f"SELECT event_id, block_id FROM ({_BLOCKED}) WHERE {where}")
    def query(spark, sf_dir):
        e, blocks = stored_events(spark, sf_dir)
        return e.pruned(text, blocks).query(text).select("event_id", "block_id")


_pruned("block_prune", "event_id:[1500 TO 3500]", "event_id BETWEEN 1500 AND 3500")
_pruned("block_prune_type", "event_id:int: 1234 OR event_id = 17", "event_id IN (17, 1234)")
_pruned("block_prune_text", "event_type:purchase AND user_id < 30 AND event_id >= 2000", "event_type = 'purchase' AND user_id < 30 AND event_id >= 2000")
_pruned("block_prune_not", "NOT event_id > 2500 AND NOT event_type:click", "event_id <= 2500 AND event_type <> 'click'")


@register("block_prune_time", f"SELECT event_id, block_id FROM ({_BLOCKED}) WHERE ts BETWEEN (SELECT min(ts) FROM events) AND (SELECT min(ts) FROM events) + INTERVAL 2 HOUR")
def block_prune_time(spark, sf_dir):
    e, blocks = stored_events(spark, sf_dir)
    low = F.min("ts").cast("timestamp")
    first, last = read(spark, sf_dir, "events").agg(low.cast("string"), (low + F.expr("interval 2 hours")).cast("string")).first()
    text = f'ts:["{first}" TO "{last}"]'
    return e.pruned(text, blocks).query(text).select("event_id", "block_id")


@register("block_time_range", f"SELECT block_id FROM ({_BLOCKED}) GROUP BY 1 HAVING min(ts) <= (SELECT min(ts) FROM events) + INTERVAL 2 HOUR")
def block_time_range(spark, sf_dir):
    _, blocks = stored_events(spark, sf_dir)
    low = F.min("ts").cast("timestamp")
    first, last = read(spark, sf_dir, "events").agg(low.cast("string"), (low + F.expr("interval 2 hours")).cast("string")).first()
    return pruning.with_range(blocks, "ts", first, last)


@register("block_select_fields", "SELECT CAST(event_id // 1000 AS BIGINT) AS block_id FROM events GROUP BY 1 HAVING count(user_id) > 0 AND count(event_type) > 0")
def block_select_fields(spark, sf_dir):
    return pruning.with_fields(stored_events(spark, sf_dir)[1], ["user_id", "event_type"])


@register("block_select_types", "SELECT CAST(event_id // 1000 AS BIGINT) AS block_id FROM events GROUP BY 1 HAVING count(user_id) > 0 AND count(value) > 0")
def block_select_types(spark, sf_dir):
    return pruning.with_types(stored_events(spark, sf_dir)[1], {"user_id": "int", "value": "double"})


@register("block_select_query", f"SELECT block_id FROM ({_BLOCKED}) GROUP BY 1 HAVING min(event_id) <= 3500 AND max(event_id) >= 1500 AND min(event_type) <= 'click' AND max(event_type) >= 'click'")
def block_select_query(spark, sf_dir):
    return pruning.select_blocks(stored_events(spark, sf_dir)[1], "event_id:[1500 TO 3500] AND event_type:click")


@register(
    "block_strategy",
    """WITH b AS (SELECT CAST(event_id // 1000 AS BIGINT) AS block_id, min(event_id) AS low, max(event_id) AS high FROM events GROUP BY 1)
    SELECT count(*) AS blocks, count(*) FILTER (WHERE low <= 3500 AND high >= 1500) AS chosen,
    round(count(*) FILTER (WHERE low <= 3500 AND high >= 1500) / count(*), 6) AS ratio, count(*) FILTER (WHERE low <= 3500 AND high >= 1500) / count(*) > 0.8 AS full_scan FROM b""",
)
def block_strategy(spark, sf_dir):
    blocks = stored_events(spark, sf_dir)[1]
    return pruning.strategy(blocks, pruning.with_range(blocks, "event_id", 1500, 3500)).withColumn("ratio", F.round("ratio", 6))


@register(
    "block_catalog",
    """SELECT CAST(event_id // 1000 AS BIGINT) AS block_id, 'user_id' AS name, 'int' AS type, count(user_id) AS occurrences, CAST(min(user_id) AS DOUBLE) AS low,
    CAST(max(user_id) AS DOUBLE) AS high, NULL AS first, NULL AS last FROM events GROUP BY 1 HAVING count(user_id) > 0
    UNION ALL SELECT CAST(event_id // 1000 AS BIGINT), 'event_type', 'string', count(event_type), NULL, NULL, min(event_type), max(event_type) FROM events GROUP BY 1 HAVING count(event_type) > 0""",
)
def block_catalog(spark, sf_dir):
    return stored_events(spark, sf_dir)[1].where("name in ('user_id', 'event_type')")


@register("selective_load", "SELECT event_id, event_type FROM events WHERE event_id // 1000 IN (0, 2)")
def selective_load(spark, sf_dir):
    return store.load(spark, event_store(spark, sf_dir), blocks=[0, 2], columns=["event_id", "event_type"])


@register("store_rebuild", """SELECT '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS record FROM events""")
def store_rebuild(spark, sf_dir):
    e = stored_events(spark, sf_dir)[0]
    return Engine(e.df, [f for f in e.fields if f.name in ("event_id", "user_id", "event_type")]).to_json()


@register("store_stats", f"SELECT count(*) AS records, count(DISTINCT block_id) AS blocks, CAST(sum(strlen(CAST(to_json({{event_id: event_id, user_id: user_id, event_type: event_type}}) AS VARCHAR))) AS BIGINT) AS json_bytes FROM ({_BLOCKED})")
def store_stats(spark, sf_dir):
    return store.compression_stats(spark, event_store(spark, sf_dir), ["event_id", "user_id", "event_type"]).where("stored_bytes > 0 and ratio > 0").select("records", "blocks", "json_bytes")


@register("store_append", "SELECT CAST(event_id % 2 AS BIGINT) AS block_id, count(*) AS records, sum(k) AS sum_k, count(*) FILTER (WHERE x <> '') AS texts FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id END AS k, CASE WHEN event_id % 2 = 1 THEN event_type END AS x FROM events) GROUP BY 1")
def store_append(spark, sf_dir):
    """Blocks of which one holds ``x`` as a number and the other as a string."""
    root = work_folder(spark, "append")
    for part, column in ((0, "user_id"), (1, "event_type")):
        df = read(spark, sf_dir, "events").where(F.col("event_id") % 2 == part).select(F.col(column).alias("x"), F.lit(part).cast("bigint").alias("block_id"))
        Engine(df).save(root, mode="append")
    e = Engine.from_store(spark, root)
    return e.df.groupBy("block_id").agg(F.count(F.lit(1)).alias("records"), F.sum("x__int").alias("sum_k"), F.count(F.when(F.col("x__string") != "", 1)).alias("texts"))


def event_lines(spark: SparkSession, sf_dir: str) -> str:
    """A folder of JSON lines of the events, written once a session."""
    key = spark.sparkContext.applicationId, f"{sf_dir}#lines"
    if key not in _STORES:
        root = work_folder(spark, "lines")
        line = F.to_json(F.struct("event_id", "event_type", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("at_text"), (F.col("value") > 50).alias("high")))
        ndjson.write_lines(read(spark, sf_dir, "events").select(line.alias("record")), root)
        _STORES[key] = root
    return _STORES[key]


_LINE = "SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at_text, value > 50 AS high FROM events"


@register("files_scan", f"SELECT event_type, count(*) AS count FROM ({_LINE}) GROUP BY 1")
def files_scan(spark, sf_dir):
    return Engine.from_files(spark, event_lines(spark, sf_dir)).group(["event_type"])


@register("files_limit", "SELECT least(count(*), 500) AS records FROM events")
def files_limit(spark, sf_dir):
    return ndjson.read_lines(spark, event_lines(spark, sf_dir), limit=500).agg(F.count(F.lit(1)).alias("records"))


@register("files_blocks", "SELECT CAST(i // 700 AS BIGINT) AS block_id, count(*) AS records FROM (SELECT row_number() OVER () - 1 AS i FROM events) GROUP BY 1")
def files_blocks(spark, sf_dir):
    lines = ndjson.with_blocks(ndjson.read_lines(spark, event_lines(spark, sf_dir)), 700)
    return lines.groupBy("block_id").agg(F.count(F.lit(1)).alias("records"))


@register("bool_less", f"SELECT event_id FROM ({_LINE}) WHERE high < true")
def bool_less(spark, sf_dir):
    return Engine.from_files(spark, event_lines(spark, sf_dir)).query("high < true").select("event_id")


@register("text_time_equal", f"SELECT event_id FROM ({_LINE}) WHERE at_text = (SELECT max(at_text) FROM ({_LINE}))")
def text_time_equal(spark, sf_dir):
    e = Engine.from_files(spark, event_lines(spark, sf_dir))
    return e.point("at_text", e.df.agg(F.max("at_text")).first()[0], "timestamp").select("event_id")


@register("log_equal", "SELECT doc_id FROM documents WHERE text = (SELECT min(text) FROM documents WHERE contains(text, ' '))")
def log_equal(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "text")).alias("value"))
    e = Engine.from_json(df.select("value"))
    wanted = e.df.agg(F.min(e.resolver.find("text", "logtype")[0].col())).first()[0]
    return e.point("text", wanted, "logtype").select("doc_id")


@register("stream_ingest", f"SELECT event_type, count(*) AS count, count(*) FILTER (WHERE high) AS high FROM ({_LINE}) GROUP BY 1")
def stream_ingest(spark, sf_dir):
    """The lines as a stream of micro-batches into a store, then a group query over the store."""
    source, root = event_lines(spark, sf_dir), work_folder(spark, "stream")
    leaves = ingest.learn(ndjson.read_lines(spark, source))
    ingest.ingest(spark, source, f"{root}/store", leaves, f"{root}/checkpoint").awaitTermination()
    e = Engine.from_store(spark, f"{root}/store")
    return e.df.groupBy("event_type").agg(F.count(F.lit(1)).alias("count"), F.count(F.when(F.col("high"), 1)).alias("high"))


@register("windowed_counts", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    found = ingest.windowed_counts(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 hour")
    return found.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


# --- codes, scores and analysis -----------------------------------------------------------------------------------


@register("field_redundancy", f"WITH {_CELLS} SELECT name, round(CASE WHEN distinct_values > 1 THEN (1 - (log2(occurrences) - nlogn / occurrences) / log2(distinct_values)) * occurrences ELSE occurrences END, 2) AS redundancy FROM s")
def field_redundancy(spark, sf_dir):
    return events(spark, sf_dir).field_stats(STAT_FIELDS).select("name", F.round("redundancy", 2).alias("redundancy"))


@register(
    "missing_ratio_blocks",
    """SELECT CAST(doc_id // 100 AS BIGINT) AS block_id, round(sum(CASE WHEN d.text IS NULL THEN 1 ELSE 0 END + CASE WHEN l.quality IS NULL THEN 1 ELSE 0 END) / (count(*) * 2), 6) AS missing_ratio,
    sum(CASE WHEN d.text IS NULL THEN 1 ELSE 0 END + CASE WHEN l.quality IS NULL THEN 1 ELSE 0 END) / (count(*) * 2) < 0.05 AS appropriate
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""",
)
def missing_ratio_blocks(spark, sf_dir):
    df = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    df = df.select("text", "quality", F.floor(F.col("doc_id") / 100).cast("bigint").alias("block_id"))
    return Engine(df).missing_ratio(by_block=True).withColumn("missing_ratio", F.round("missing_ratio", 6))


@register(
    "template_codes",
    f"""SELECT row_number() OVER (ORDER BY template) AS code, template, n
    FROM (SELECT regexp_replace(text, '{LOG_PATTERN}', '*', 'g') AS template, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1)""",
)
def template_codes(spark, sf_dir):
    e = Engine(read(spark, sf_dir, "conversations"))
    return catalog.template_codes(e.df, e.resolver, "text")


@register(
    "variable_codes",
    f"""SELECT row_number() OVER (ORDER BY variable) AS code, variable, n
    FROM (SELECT variable, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{LOG_PATTERN}')) AS variable FROM documents WHERE text IS NOT NULL) GROUP BY 1)""",
)
def variable_codes(spark, sf_dir):
    e = Engine(read(spark, sf_dir, "documents").select("text"))
    return catalog.variable_codes(e.df, e.resolver, "text")


@register(
    "query_analysis",
    f"""SELECT column_name AS field, {_TYPES} AS type, column_name IN ('event_type', 'user_id') AS required FROM (DESCRIBE events) WHERE column_name IN ('event_type', 'user_id', 'value')""",
)
def query_analysis(spark, sf_dir):
    found = events(spark, sf_dir).analyse("user_id > 3 AND (event_type:click OR event_type:error) AND (value < 5 OR user_id = 7)")
    rows = [(name, kind, name in found["required"]) for name, kinds in found["fields"].items() for kind in kinds]
    return spark.createDataFrame(rows, "field string, type string, required boolean")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(events(spark, sf_dir).query(FLAGSHIP))

