"""One registered query per operator, over whole tables, with the SQL that a plain engine answers it by.

View ``docs``: every event as a navigable document. View ``texts``: every event
as document text with typed scalars. ``ORACLES`` are DuckDB SQL on the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.register import call, register
from ..operators import construct, pathindex
from ..operators.containment import contains
from ..sources import lines
from ..streaming import events as streaming
from ..text import WriteOptions

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations", "documents")

_NS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) * 1000"
_DOCS = f"""SELECT event_id, user_id, event_type, value, ts, props, parse_json(concat('{{"id":{{"$n":"', event_id, '"}},"type":"', event_type, '","value":', value, ',"user":', user_id, ',"props":', props,
  ',"tags":["t', user_id % 3, '","', event_type, '",null],"at":{{"$i":', {_NS}, '}},"price":{{"$m":"', CAST(value AS DECIMAL(18,2)), '"}},"took":{{"$p":"PT', user_id % 90, 'M"}}', if(user_id % 2 = 0, ',"even":null', ''), '}}')) AS v FROM events"""
_TEXTS = "SELECT event_id, concat('// event\n{id: ', event_id, 'n, type: ''', event_type, ''', \"price\": ', CAST(value AS DECIMAL(18,2)), 'm, nested: {a: [1, 2, null,], b: null,}, user: ', user_id, ',}') AS t FROM events"


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt anew, evenly: a table may have fewer row groups than there are cores, and documents cost far more to make than to move."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def open_views(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of the tables, and docs and texts over them. Only what a query reads is ever scanned."""
    register(spark)
    for name in TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (spread(table) if name == "events" else table).createOrReplaceTempView(name)
    spark.sql(_DOCS).createOrReplaceTempView("docs")
    spark.sql(_TEXTS).createOrReplaceTempView("texts")


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _sql(name: str, spark_sql: str, oracle: str | None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        open_views(spark, sf_dir)
        return spark.sql(spark_sql)

    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def _py(oracle: str | None):
    def add(f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            open_views(spark, sf_dir)
            return f(spark)

        QUERIES[f.__name__] = query
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a key with a value of at least 50: count and mean per type. No Python in the plan."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("v", F.parse_json("props"))
    k = F.try_variant_get("v", "$.k", "int")
    return e.where(k >= 50).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean")).orderBy(F.desc("n"), "event_type")


QUERIES["flagship"] = flagship
ORACLES["flagship"] = "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events WHERE json_exists(props, '$.k') AND CAST(props->>'k' AS INT) >= 50 GROUP BY 1"

# ---------------------------------------------------------------- navigation N1-N13
_sql("n1_field", "SELECT event_id, try_variant_get(xd_field(v, 'user'), '$', 'bigint') AS x, xd_field(v, 'absent') IS NULL AS gone FROM docs", "SELECT event_id, user_id AS x, true AS gone FROM events")
_sql("n2_field_text", "SELECT event_id, xd_field_text(v, 'type') AS s, xd_field_text(v, 'id') AS n, xd_field_text(v, 'even') AS e FROM docs", "SELECT event_id, event_type AS s, event_id || 'n' AS n, CASE WHEN user_id % 2 = 0 THEN 'null' END AS e FROM events")
_sql("n3_element", "SELECT event_id, xd_text(xd_element(xd_field(v, 'tags'), 0)) AS a, xd_text(xd_element(xd_field(v, 'tags'), -2)) AS b, xd_element(xd_field(v, 'tags'), 9) IS NULL AS gone FROM docs", "SELECT event_id, 't' || user_id % 3 AS a, event_type AS b, true AS gone FROM events")
_sql("n4_element_text", "SELECT event_id, xd_element_text(xd_field(v, 'tags'), -1) AS last FROM docs", "SELECT event_id, 'null' AS last FROM events")
_sql("n5_path", "SELECT event_id, try_variant_get(xd_path(v, array('props', 'k')), '$', 'bigint') AS k, xd_path(v, array('tags', '-1')) IS NULL AS gone FROM docs", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, true AS gone FROM events")
_sql("n6_path_text", "SELECT event_id, xd_path_text(v, array('tags', '1')) AS t, xd_path_text(v, array('tags', '2')) AS nothing FROM docs", "SELECT event_id, event_type AS t, CAST(NULL AS VARCHAR) AS nothing FROM events")
_sql("n7_uuid", "SELECT event_id, xd_extract_uuid(parse_json(concat('{\"u\":{\"$u\":\"550e8400-e29b-41d4-a716-', lpad(event_id, 12, '0'), '\"}}')), array('u')) AS u FROM docs", "SELECT event_id, '550e8400-e29b-41d4-a716-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS u FROM events")
_sql("n8_numeric", "SELECT event_id, CAST(xd_extract_numeric(v, array('price')) AS DOUBLE) AS price, CAST(xd_extract_numeric(v, array('id')) AS BIGINT) AS id, xd_extract_numeric(v, array('type')) IS NULL AS none FROM docs", "SELECT event_id, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS price, event_id AS id, true AS none FROM events")
_sql("n9_timestamp", "SELECT event_id, unix_micros(xd_extract_timestamp(v, array('at'))) AS us FROM docs", "SELECT event_id, epoch_us(ts) AS us FROM events")
_sql("n10_instant", "SELECT event_id, xd_extract_instant(v, array('at')).ns AS ns FROM docs", "SELECT event_id, epoch_us(ts) * 1000 AS ns FROM events")
_sql("n11_duration", "SELECT event_id, xd_approx_ns(xd_extract_duration(v, array('took'))) AS ns FROM docs", "SELECT event_id, user_id % 90 * 60000000000 AS ns FROM events")
_sql("n12_typeof", "SELECT event_id, xd_typeof(v) AS a, xd_typeof(xd_field(v, 'id')) AS b, xd_typeof(xd_field(v, 'price')) AS c, xd_typeof(xd_field(v, 'at')) AS d, xd_typeof(xd_field(v, 'took')) AS e, xd_typeof(xd_field(v, 'tags')) AS f, xd_typeof(xd_field(v, 'value')) AS g FROM docs", "SELECT event_id, 'object' AS a, 'bigint' AS b, 'decimal128' AS c, 'instant' AS d, 'duration' AS e, 'array' AS f, 'number' AS g FROM events")

# ---------------------------------------------------------------- predicates P1-P13
_sql("p1_exists", "SELECT event_type, count(*) AS n FROM docs WHERE xd_exists(v, 'even') AND NOT xd_exists(xd_field(v, 'tags'), 't0') GROUP BY event_type", "SELECT event_type, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1")
_sql("p2_exists_any", "SELECT event_type, count(*) AS n FROM docs WHERE xd_exists_any(v, array('absent', 'even')) GROUP BY event_type", "SELECT event_type, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1")
_sql("p3_exists_all", "SELECT event_type, count(*) AS n FROM docs WHERE xd_exists_all(v, array('type', 'even')) AND xd_exists_all(v, array()) GROUP BY event_type", "SELECT event_type, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1")


@_py("SELECT event_id FROM events WHERE event_type = 'click' AND user_id % 3 = 1")
def p4_contains(spark):
    return spark.table("docs").where(contains("v", "{type: 'click', tags: ['t1', null], props: {}}")).select("event_id")


@_py("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def p5_contained(spark):
    d = spark.table("events").select("user_id", call("parse", F.concat(F.lit("{type: '"), "event_type", F.lit("'}"))).alias("a"))
    whole = call("parse", F.lit("{type: 'click', more: 1}"))
    return d.where(call("contains", whole, F.col("a"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


_sql("p6_equal", "SELECT a.event_id FROM texts a JOIN texts b ON xd_parse(a.t) = xd_parse(b.t)", "SELECT event_id FROM events")
_sql("p7_not_equal", "SELECT count(*) AS n FROM texts WHERE xd_parse(t) <> xd_parse('{}')", "SELECT count(*) AS n FROM events")
_sql("p8_compare", "SELECT event_id FROM events WHERE xd_sort_key(xd_parse(concat(user_id, 'n'))) < xd_sort_key(xd_parse('50n'))", "SELECT event_id FROM events WHERE user_id < 50")
_sql("p9_structural", "SELECT count(*) AS n FROM texts WHERE xd_equal(xd_parse(concat('{a: 1, b: ', event_id, '}')), xd_parse(concat('{b: ', event_id, ', a: 1}')))", "SELECT count(*) AS n FROM events")
_sql("p10_instants", f"SELECT event_id FROM docs WHERE xd_instant_cmp(named_struct('ns', {_NS}, 'tz', CAST(0 AS SMALLINT)), xd_instant('2024-01-15T05:30:00+05:30')) > 0", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
_sql("p11_durations", "SELECT event_id FROM docs WHERE xd_duration_cmp(xd_extract_duration(v, array('took')), xd_duration('PT1H')) >= 0", "SELECT event_id FROM events WHERE user_id % 90 >= 60")
_sql("p12_host", "SELECT event_id, CASE WHEN xd_field_text(v, 'type') IN ('click', 'view') THEN 1 ELSE 0 END AS hot FROM docs WHERE xd_numeric(xd_field(v, 'value')) BETWEEN 10 AND 50 AND xd_field_text(v, 'type') RLIKE '^[a-z]+$'", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS hot FROM events WHERE CAST(value AS DECIMAL(38,10)) BETWEEN 10 AND 50 AND regexp_matches(event_type, '^[a-z]+$')")
_sql("p13_type_predicate", "SELECT count(*) AS n FROM docs WHERE xd_typeof(xd_field(v, 'even')) = 'null'", "SELECT count(*) AS n FROM events WHERE user_id % 2 = 0")

# ---------------------------------------------------------------- order O1-O9
_sql("o1_total_order", "SELECT t, row_number() OVER (ORDER BY xd_sort_key(xd_parse(t))) AS n FROM VALUES ('null'), ('true'), ('3'), ('2n'), ('1m'), ('''a'''), ('550e8400-e29b-41d4-a716-446655440000'), ('2020-01-01T00:00:00Z'), ('[]'), ('{}') AS x(t)", "SELECT * FROM (VALUES ('null', 1), ('true', 2), ('3', 3), ('2n', 4), ('1m', 5), ('''a''', 6), ('550e8400-e29b-41d4-a716-446655440000', 7), ('2020-01-01T00:00:00Z', 8), ('[]', 9), ('{}', 10)) x(t, n)")
_sql("o2_within_type", "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY xd_sort_key(xd_parse(concat(CAST(value AS DECIMAL(18,2)), 'm')))) AS r FROM events", "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY CAST(value AS DECIMAL(18,2))) AS r FROM events")
_sql("o3_document_min_max", "SELECT event_type, xd_decode(min_by(xd_parse(concat(user_id, 'n')), xd_sort_key(xd_parse(concat(user_id, 'n'))))) AS low FROM events GROUP BY event_type", "SELECT event_type, min(user_id) || 'n' AS low FROM events GROUP BY 1")
_sql("o4_instant_order", "SELECT event_type, max(xd_utc_ns(xd_extract_instant(v, array('at')))) AS last FROM docs GROUP BY event_type", "SELECT event_type, max(epoch_us(ts)) * 1000 AS last FROM events GROUP BY 1")
_sql("o5_duration_order", "SELECT event_type, max(xd_approx_ns(xd_extract_duration(v, array('took')))) AS longest FROM docs GROUP BY event_type", "SELECT event_type, max(user_id % 90) * 60000000000 AS longest FROM events GROUP BY 1")
_sql("o7_top_k", "SELECT event_id, try_variant_get(xd_field(v, 'value'), '$', 'double') AS x FROM docs ORDER BY x DESC, event_id LIMIT 10", "SELECT event_id, value AS x FROM events ORDER BY x DESC, event_id LIMIT 10")
_sql("o8_distinct", "SELECT count(DISTINCT xd_utc_ns(xd_extract_instant(v, array('at')))) AS instants, count(DISTINCT xd_field_text(v, 'took')) AS durations FROM docs", "SELECT count(DISTINCT ts) AS instants, count(DISTINCT user_id % 90) AS durations FROM events")
_sql("o9_sorted_keys", "SELECT event_id, xd_stringify_sorted(xd_parse(concat('{b: ', event_id, ', a: 1}'))) AS t FROM events", "SELECT event_id, '{a:1,b:' || event_id || '}' AS t FROM events")

# ---------------------------------------------------------------- text codec C1-C17, S8, S9
_sql("c1_parse_stringify", "SELECT event_id, xd_stringify(xd_parse(t)) AS t FROM texts", "SELECT event_id, '{id:' || event_id || 'n,type:''' || event_type || ''',price:' || CAST(value AS DECIMAL(18,2)) || 'm,nested:{a:[1,2,null],b:null},user:' || user_id || '}' AS t FROM events")
_sql("c5_quotes", "SELECT xd_stringify(xd_parse(t)) AS t, count(*) AS n FROM (SELECT explode(array('\"it''s\"', '''say \"x\"''', '`plain`')) AS t FROM events) GROUP BY 1", "SELECT t, count(*) AS n FROM (SELECT unnest(['\"it''s\"', '''say \"x\"''', '''plain''']) AS t FROM events) GROUP BY 1")
_sql("c6_keys", "SELECT event_id, xd_stringify(xd_parse(concat('{\"a b\": ', event_id, ', \"true\": 1, \"$ok\": 2}'))) AS t FROM events", "SELECT event_id, '{''a b'':' || event_id || ',''true'':1,$ok:2}' AS t FROM events")
_sql("c8_is_valid", "SELECT ok, count(*) AS n FROM (SELECT xd_is_valid(if(user_id % 7 = 0, concat('{a: ', event_id), t)) AS ok FROM texts JOIN events USING (event_id)) GROUP BY ok", "SELECT user_id % 7 <> 0 AS ok, count(*) AS n FROM events GROUP BY 1")
_sql("c9_parse_or", "SELECT event_id, xd_stringify(xd_parse_or(if(event_id % 2 = 0, concat(event_id, 'n'), 'oops'), '{bad: true}')) AS t FROM events", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id || 'n' ELSE '{bad:true}' END AS t FROM events")


@_py("SELECT event_id, '{\"id\":\"' || event_id || '\",\"s\":\"\\u00e9\"}' AS t FROM events")
def c11_dumps(spark):
    from ..functions.codec import writer

    out = writer(WriteOptions(json=True, sort_keys=True, ascii=True))
    return spark.table("events").select("event_id", out(call("parse", F.concat(F.lit("{s: 'é', id: "), F.col("event_id"), F.lit("n}")))).alias("t"))


@_py("SELECT event_id, event_id + 1 AS x FROM events")
def c11_object_hook(spark):
    from ..functions.codec import transformer

    def hook(doc):
        return {"x": doc["x"] + 1}

    changed = transformer(hook)(call("parse", F.concat(F.lit("{x: "), F.col("event_id"), F.lit("}"))))
    return spark.table("events").select("event_id", F.try_variant_get(F.parse_json(call("navigable", changed)), "$.x", "bigint").alias("x"))


@_py("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def c13_project(spark):
    from pyspark.sql import types as T

    df = spark.table("supplier")
    v = df.select(construct.from_row(df).alias("v"))
    schema = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()), T.StructField("s_acctbal", T.DoubleType())])
    return v.select(*construct.project(F.col("v"), schema))


@_py("SELECT CASE WHEN event_id % 3 = 0 THEN 'unexpected_token' WHEN event_id % 3 = 1 THEN 'escape' END AS code, count(*) AS n FROM events GROUP BY 1")
def c15_errors(spark):
    text = F.when(F.col("event_id") % 3 == 0, "[1 2]").when(F.col("event_id") % 3 == 1, '"\\x"').otherwise("1")
    return spark.table("events").select(lines.attempt()(text).alias("r")).groupBy(F.col("r.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- binary codec B1-B6
_sql("b1_encode", "SELECT event_id, hex(xd_parse(concat('[', event_id % 100, ', null, true]'))) AS b FROM events", "SELECT event_id, '400310' || upper(lpad(format('{:x}', event_id % 100), 2, '0')) || '0002' AS b FROM events")
_sql("b2_decode", "SELECT event_id, xd_decode(unhex(concat('4102016110', lpad(hex(event_id % 100), 2, '0'), '016200'))) AS t FROM events", "SELECT event_id, '{a:' || event_id % 100 || ',b:null}' AS t FROM events")
_sql("b3_type", "SELECT xd_binary_type(xd_parse(t)) AS b, count(*) AS n FROM texts GROUP BY 1", "SELECT 65 AS b, count(*) AS n FROM events")
_sql("b4_is_valid", "SELECT ok, count(*) AS n FROM (SELECT xd_is_valid_binary(unhex(if(event_id % 4 = 0, '2005', '2000'))) AS ok FROM events) GROUP BY ok", "SELECT event_id % 4 <> 0 AS ok, count(*) AS n FROM events GROUP BY 1")

# ---------------------------------------------------------------- constructors and casts K1-K19


@_py("SELECT event_id, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS t FROM events")
def k1_object(spark):
    df = spark.table("events")
    return df.select("event_id", F.to_json(construct.build_object(df, "id", F.col("event_id"), "type", F.col("event_type"), plain=True)).alias("t"))


@_py("SELECT event_id, '[' || user_id || ',\"' || event_type || '\",null,true]' AS t FROM events")
def k2_array(spark):
    df = spark.table("events")
    return df.select("event_id", F.to_json(construct.build_array(df, F.col("user_id"), F.col("event_type"), F.lit(None).cast("string"), F.lit(True), plain=True)).alias("t"))


@_py("SELECT n_nationkey AS k, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS t FROM nation")
def k3_from_row(spark):
    df = spark.table("nation")
    return df.select(F.col("n_nationkey").alias("k"), F.to_json(construct.from_row(df)).alias("t"))


@_py("SELECT s_suppkey AS k, '{s_suppkey:' || s_suppkey || 'n,s_name:''' || s_name || ''',s_nationkey:' || s_nationkey || '}' AS t FROM supplier")
def k3_row_in_order(spark):
    """Members in column order."""
    df = spark.table("supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"))
    df = df.withColumn("s_suppkey", F.col("s_suppkey").cast("long"))
    return df.select(F.col("s_suppkey").alias("k"), call("stringify", construct.row_document(df)).alias("t"))


@_py("SELECT event_id, '{type:''' || event_type || ''',id:' || event_id || 'n,at:null}' AS t FROM events")
def k1_object_in_order(spark):
    df = spark.table("events")
    return df.select("event_id", call("stringify", construct.object_document(df, "type", F.col("event_type"), "id", F.col("event_id"), "at", F.lit(None).cast("string"))).alias("t"))


@_py("SELECT o_orderkey, 'bigint' AS a, 'string' AS b, 'number' AS c FROM orders")
def k4_typing(spark):
    df = spark.table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    v = df.select("o_orderkey", construct.from_row(df).alias("v"))
    return v.select("o_orderkey", *(call("typeof", call("field", F.col("v"), c)).alias(n) for n, c in (("a", "o_orderkey"), ("b", "o_orderstatus"), ("c", "o_totalprice"))))


_sql("k5_build_temporal", "SELECT event_id, xd_stringify(xd_parse(xd_instant_text(xd_extract_instant(v, array('at'))))) = xd_field_text(v, 'at') AS same FROM docs", "SELECT event_id, true AS same FROM events")
_sql("k7_to_json", "SELECT event_id, xd_to_json(xd_parse(t)) AS t FROM texts", "SELECT event_id, '{\"id\":\"' || event_id || '\",\"type\":\"' || event_type || '\",\"price\":' || CAST(value AS DECIMAL(18,2)) || ',\"nested\":{\"a\":[1,2,null],\"b\":null},\"user\":' || user_id || '}' AS t FROM events")
_sql("k8_to_variant", "SELECT event_id, try_variant_get(parse_json(xd_to_json(xd_parse(t))), '$.user', 'bigint') AS u FROM texts", "SELECT event_id, user_id AS u FROM events")
_sql("k9_from_json", "SELECT event_id, xd_stringify(xd_parse(props)) AS t FROM events", "SELECT event_id, '{k:' || CAST(props->>'k' AS BIGINT) || '}' AS t FROM events")
_sql("k10_from_variant", "SELECT event_id, xd_stringify(xd_from_navigable(to_json(v))) = xd_stringify(xd_parse(xd_stringify(xd_from_navigable(to_json(v))))) AS same FROM docs", "SELECT event_id, true AS same FROM events")
_sql("k12_strip_nulls", "SELECT event_id, xd_stringify(xd_strip_nulls(xd_parse(t))) AS t FROM texts", "SELECT event_id, '{id:' || event_id || 'n,type:''' || event_type || ''',price:' || CAST(value AS DECIMAL(18,2)) || 'm,nested:{a:[1,2]},user:' || user_id || '}' AS t FROM events")
_sql("k13_pretty", "SELECT event_id, xd_pretty(xd_parse(concat('{a: [', event_id, ']}')), 2) AS t FROM events", "SELECT event_id, '{' || chr(10) || '  a: [' || chr(10) || '    ' || event_id || chr(10) || '  ]' || chr(10) || '}' AS t FROM events")
_sql("k15_array_length", "SELECT event_id, CAST(xd_array_length(xd_field(v, 'tags')) AS INT) AS n FROM docs", "SELECT event_id, CAST(3 AS INT) AS n FROM events")
_sql("k16_elements", "SELECT event_id, xd_typeof(e.col) AS kind FROM (SELECT event_id, xd_elements(xd_field(v, 'tags')) AS es FROM docs), LATERAL explode(es) AS e", "SELECT event_id, unnest(['string', 'string', 'null']) AS kind FROM events")
_sql("k17_elements_text", "SELECT event_id, e.col AS t FROM (SELECT event_id, xd_elements_text(xd_field(v, 'tags')) AS es FROM docs), LATERAL explode(es) AS e", "SELECT event_id, unnest(['t' || user_id % 3, event_type, 'null']) AS t FROM events")
_sql("k18_keys", "SELECT e.col AS k, count(*) AS n FROM (SELECT xd_keys(v) AS ks FROM docs), LATERAL explode(ks) AS e GROUP BY 1", "SELECT k, count(*) AS n FROM (SELECT unnest(['id', 'type', 'value', 'user', 'props', 'tags', 'at', 'price', 'took']) AS k FROM events UNION ALL SELECT 'even' FROM events WHERE user_id % 2 = 0) GROUP BY 1")

_sql("k18_stored_keys", "SELECT event_id, array_join(xd_stored_keys(xd_parse(t)), ' ') AS ks FROM texts", "SELECT event_id, 'id type price nested user' AS ks FROM events")
_sql("k6_set_append", "SELECT event_id, xd_decode(xd_with_member(xd_with_member(xd_parse(concat('{b: 1, a: ', event_id, '}')), 'c', xd_appended(xd_parse('[1]'), xd_parse(concat(user_id, 'n')))), 'b', xd_parse('null'))) AS t FROM events", "SELECT event_id, '{b:null,a:' || event_id || ',c:[1,' || user_id || 'n]}' AS t FROM events")
_sql("k5_instant_text", "SELECT event_id, xd_stringify(xd_parse(xd_instant_text(xd_extract_instant(v, array('at'))))) AS t FROM docs", "SELECT event_id, rtrim(rtrim(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '0'), '.') || 'Z' AS t FROM events")

# ---------------------------------------------------------------- aggregates A1-A6


@_py("SELECT l_orderkey, '{' || string_agg('\"' || l_returnflag || '\":' || l_linenumber, ',' ORDER BY l_linenumber, l_returnflag) || '}' AS t FROM (SELECT l_orderkey, l_returnflag, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def a2_last_wins(spark):
    """Keys that repeat within a group."""
    df = spark.table("lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("int"))
    return df.groupBy("l_orderkey").agg(construct.object_agg(F.col("l_returnflag"), construct.typed(df, "l_linenumber"), F.col("l_linenumber")).alias("t"))


@_py("SELECT o_custkey, '[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) || ']' AS t FROM orders GROUP BY 1")
def a1_array_agg(spark):
    df = spark.table("orders")
    return df.groupBy("o_custkey").agg(construct.array_agg(construct.typed(df, "o_orderkey", plain=True), F.col("o_orderkey")).alias("t"))


@_py("SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS t FROM nation GROUP BY 1")
def a2_object_agg(spark):
    df = spark.table("nation")
    return df.groupBy("n_regionkey").agg(construct.object_agg(F.col("n_name"), construct.typed(df, "n_nationkey"), F.col("n_name")).alias("t"))


@_py("SELECT conv_id, '[' || string_agg('\"' || role || '\"', ',' ORDER BY turn DESC) || ']' AS t FROM conversations GROUP BY 1")
def a3_ordered_agg(spark):
    df = spark.table("conversations")
    return df.groupBy("conv_id").agg(construct.array_agg(construct.typed(df, "role"), F.col("turn"), descending=True).alias("t"))


_sql("a4_group_by_path", "SELECT xd_path_text(v, array('tags', '0')) AS tag, count(*) AS n, CAST(sum(xd_extract_numeric(v, array('price'))) AS DOUBLE) AS total FROM docs GROUP BY 1", "SELECT 't' || user_id % 3 AS tag, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1")
_sql("a5_success_rate", "SELECT event_type, sum(CASE WHEN xd_exists(v, 'even') THEN 1 ELSE 0 END) AS ok, count(*) AS n, min(xd_utc_ns(xd_extract_instant(v, array('at')))) AS first FROM docs GROUP BY event_type", "SELECT event_type, CAST(sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ok, count(*) AS n, min(epoch_us(ts)) * 1000 AS first FROM events GROUP BY 1")
_sql("a6_rollup", "SELECT xd_field_text(v, 'type') AS t, xd_path_text(v, array('tags', '0')) AS tag, count(*) AS n FROM docs GROUP BY ROLLUP (xd_field_text(v, 'type'), xd_path_text(v, array('tags', '0')))", "SELECT event_type AS t, 't' || user_id % 3 AS tag, count(*) AS n FROM events GROUP BY ROLLUP (event_type, 't' || user_id % 3)")

# ---------------------------------------------------------------- joins, windows, sets
_sql("j1_equi_join", "SELECT c.c_custkey, count(*) AS n FROM docs d JOIN customer c ON try_variant_get(xd_field(d.v, 'user'), '$', 'bigint') = c.c_custkey GROUP BY 1", "SELECT c_custkey, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY 1")
_sql("j2_theta_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
_sql("j3_semi_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN docs ON try_variant_get(xd_field(v, 'user'), '$', 'bigint') = c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
_sql("j4_recursive", "WITH RECURSIVE s(n, i) AS (SELECT 0, xd_instant_text(xd_instant('2025-01-01T00:00:00Z')) UNION ALL SELECT n + 1, xd_instant_text(xd_instant_plus(xd_instant(i), xd_duration('PT1M'))) FROM s WHERE n < 4) SELECT n, i FROM s", "SELECT CAST(range AS INT) AS n, '2025-01-01T00:0' || range || ':00.000000000Z' AS i FROM range(5)")
_sql("w1_window", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY xd_utc_ns(xd_extract_instant(v, array('at'))), event_id) AS r FROM docs", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events")
_sql("u1_union_all", "SELECT xd_field_text(v, 'type') AS t FROM docs UNION ALL SELECT r_name FROM region", "SELECT event_type AS t FROM events UNION ALL SELECT r_name FROM region")
_sql("u2_set_ops", "SELECT xd_decode(d) AS t FROM (SELECT xd_parse(concat(user_id, 'n')) AS d FROM events EXCEPT SELECT xd_parse(concat(c_custkey * 2, 'n')) FROM customer)", "SELECT user_id || 'n' AS t FROM (SELECT user_id FROM events EXCEPT SELECT c_custkey * 2 FROM customer)")
_sql("j5_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN docs ON try_variant_get(xd_field(v, 'user'), '$', 'bigint') = c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
_sql("j6_outer", "SELECT c_custkey, count(event_id) AS n, max(xd_field_text(v, 'type')) AS last FROM customer LEFT JOIN docs ON try_variant_get(xd_field(v, 'user'), '$', 'bigint') = c_custkey GROUP BY c_custkey", "SELECT c_custkey, count(event_id) AS n, max(event_type) AS last FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1")
_sql("j7_inequality", "SELECT n_name, r_name FROM nation JOIN region ON xd_instant_cmp(xd_from_epoch(CAST(n_nationkey AS DOUBLE)), xd_from_epoch(CAST(r_regionkey AS DOUBLE))) < 0", "SELECT n_name, r_name FROM nation JOIN region ON n_nationkey < r_regionkey")
_sql("i10_epochs", "SELECT event_id, xd_epoch_ms(at) AS ms, xd_instant_text(xd_from_epoch_ms(xd_epoch_ms(at))) = xd_instant_text(xd_from_epoch_ns(xd_epoch_ms(at) * 1000000)) AS same_text, xd_same_instant(at, xd_from_epoch_ns(xd_utc_ns(at))) AS same, xd_duration_text(xd_since(at, xd_from_epoch_ms(1704067200000))) = xd_duration_text(xd_negate(xd_until(at, xd_from_epoch_ms(1704067200000)))) AS opposite, xd_total(xd_until(at, xd_from_epoch_ms(1704067200000)), 'seconds') AS seconds FROM (SELECT event_id, xd_extract_instant(v, array('at')) AS at FROM docs)", "SELECT event_id, epoch_us(ts) // 1000 AS ms, true AS same_text, true AS same, true AS opposite, CAST(trunc((1704067200000000 - epoch_us(ts)) / 1000000.0) AS BIGINT) AS seconds FROM events")


_sql("w2_lag_and_running_sum", f"SELECT event_id, xd_duration_text(xd_between(at, lag(at) OVER w)) AS since, sum(price) OVER w AS so_far FROM (SELECT event_id, user_id, xd_extract_instant(v, array('at')) AS at, CAST(xd_numeric(xd_field(v, 'price')) AS DOUBLE) > 50 AS dear, CAST(xd_numeric(xd_field(v, 'id')) AS BIGINT) AS price FROM docs) WINDOW w AS (PARTITION BY user_id ORDER BY at.ns, event_id)", """SELECT event_id, CASE WHEN d IS NULL THEN NULL WHEN d = 0 THEN 'PT0S' ELSE 'PT' || d // 1000000 || CASE WHEN d % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(d % 1000000 AS VARCHAR), 6, '0') || '000' END || 'S' END AS since, so_far FROM (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS d, CAST(sum(event_id) OVER w AS BIGINT) AS so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
_sql("u3_union", "SELECT xd_field_text(v, 'type') AS t FROM docs UNION SELECT r_name FROM region", "SELECT event_type AS t FROM events UNION SELECT r_name FROM region")
_sql("u4_intersect", "SELECT xd_decode(d) AS t FROM (SELECT xd_parse(concat(user_id, 'n')) AS d FROM events INTERSECT SELECT xd_parse(concat(c_custkey * 2, 'n')) FROM customer)", "SELECT user_id || 'n' AS t FROM (SELECT user_id FROM events INTERSECT SELECT c_custkey * 2 FROM customer)")

# ---------------------------------------------------------------- instants I1-I11
_T = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"
_AT = "xd_extract_instant(v, array('at'))"
_sql("i1_parse", f"SELECT event_id, xd_utc_ns(xd_instant(replace(xd_instant_text({_AT}), 'Z', '+05:30'))) AS ns FROM docs", "SELECT event_id, epoch_us(ts) * 1000 - 19800000000000 AS ns FROM events")
_sql("i2_text", f"SELECT event_id, xd_instant_text({_AT}) AS t FROM docs", f"SELECT event_id, {_T} || '000Z' AS t FROM events")
_sql("i3_now", "SELECT xd_utc_ns(xd_now()) > xd_utc_ns(xd_instant('2024-01-01T00:00:00Z')) AS later, xd_typeof(parse_json('{\"$i\":1}')) AS t", "SELECT true AS later, 'instant' AS t")
_sql("i4_i5_timestamps", f"SELECT event_id, unix_micros(xd_to_timestamp(xd_from_timestamp(xd_to_timestamp({_AT})))) AS us FROM docs", "SELECT event_id, epoch_us(ts) AS us FROM events")
_sql("i6_i7_epoch", f"SELECT event_id, xd_epoch({_AT}) AS x, xd_from_epoch(CAST(user_id AS DOUBLE)).ns AS ns FROM docs", "SELECT event_id, epoch_us(ts) * 1000 / CAST(1000000000 AS DOUBLE) AS x, user_id * 1000000000 AS ns FROM events")
_sql("i8_arithmetic", f"SELECT event_id, xd_instant_plus({_AT}, xd_duration('P1M1DT0.000000001S')).ns AS a, xd_instant_minus({_AT}, xd_duration('-PT1H')).ns AS b FROM docs", "SELECT event_id, epoch_us(ts) * 1000 + 31 * 86400000000000 + 1 AS a, epoch_us(ts) * 1000 + 3600000000000 AS b FROM events")
_sql("i9_difference", f"SELECT event_id, xd_duration_text(xd_between(xd_instant('2000-01-01T00:00:00Z'), xd_instant_plus(xd_instant('2000-01-01T00:00:00Z'), xd_extract_duration(v, array('took'))))) AS t FROM docs", "SELECT event_id, CASE WHEN user_id % 90 = 0 THEN 'PT0S' ELSE '-PT' || user_id % 90 * 60 || 'S' END AS t FROM events")
_sql("i11_document_add", "SELECT event_id, xd_decode(xd_add(xd_parse('2025-01-01T00:00:00Z'), xd_parse(concat('PT', user_id % 60, 'S')))) AS t FROM events", "SELECT event_id, '2025-01-01T00:00:' || lpad(CAST(user_id % 60 AS VARCHAR), 2, '0') || 'Z' AS t FROM events")

# ---------------------------------------------------------------- durations D1-D9
_P = "xd_duration(concat('P', user_id % 5, 'DT', user_id % 90, 'M'))"
_PD = "(user_id % 5 * 86400 + user_id % 90 * 60)"
_sql("d1_parse", f"SELECT event_id, xd_approx_ns({_P}) AS ns, xd_duration('P1D!') IS NULL AS bad FROM events", f"SELECT event_id, {_PD} * 1000000000 AS ns, true AS bad FROM events")
_sql("d2_text", f"SELECT event_id, xd_duration_text({_P}) AS t FROM events", "SELECT event_id, 'P' || CASE WHEN user_id % 5 > 0 THEN user_id % 5 || 'D' ELSE '' END || CASE WHEN user_id % 90 > 0 THEN 'T' || user_id % 90 || 'M' WHEN user_id % 5 = 0 THEN 'T0S' ELSE '' END AS t FROM events")
_sql("d3_arithmetic", f"SELECT event_id, xd_approx_ns(xd_duration_plus({_P}, xd_duration('-PT1H'))) AS a, xd_approx_ns(xd_duration_minus({_P}, xd_duration('P1Y'))) AS b FROM events", f"SELECT event_id, ({_PD} - 3600) * 1000000000 AS a, ({_PD} - 365 * 86400) * 1000000000 AS b FROM events")
_sql("d4_negate", f"SELECT event_id, xd_approx_ns(xd_negate({_P})) AS a, xd_approx_ns(xd_abs(xd_negate({_P}))) AS b FROM events", f"SELECT event_id, -{_PD} * 1000000000 AS a, {_PD} * 1000000000 AS b FROM events")
_sql("d5_d6_seconds", f"SELECT event_id, xd_seconds({_P}) AS s, xd_approx_ns(xd_from_seconds(xd_seconds({_P}))) AS ns FROM events", f"SELECT event_id, CAST({_PD} AS DOUBLE) AS s, {_PD} * 1000000000 AS ns FROM events")
_sql("d7_total", f"SELECT event_id, xd_total({_P}, 'hours') AS h, xd_total({_P}, 'minutes') AS m FROM events", f"SELECT event_id, {_PD} // 3600 AS h, {_PD} // 60 AS m FROM events")
_sql("d8_scale", f"SELECT event_id, xd_approx_ns(xd_scale({_P}, 3)) AS a, xd_approx_ns(xd_divide({_P}, 2)) AS b, xd_is_zero({_P}) AS z, xd_is_negative(xd_negate({_P})) AS n FROM events", f"SELECT event_id, {_PD} * 3000000000 AS a, {_PD} * 500000000 AS b, {_PD} = 0 AS z, {_PD} > 0 AS n FROM events")
_sql("d9_normalised", f"SELECT event_id, xd_normalised(xd_from_seconds(CAST({_PD.replace('%', '%')} AS DOUBLE))).hours AS h FROM events", f"SELECT event_id, CAST({_PD} % 86400 // 3600 AS INT) AS h FROM events")
_sql("d5_long_seconds", "SELECT event_id, xd_seconds(xd_duration(concat('P', 285 + user_id % 30, 'Y'))) AS s, xd_duration_cmp(xd_duration('P300Y'), xd_duration(concat('P', 285 + user_id % 30, 'Y'))) AS c, xd_total(xd_duration(concat('-P', 285 + user_id % 30, 'YT1.5S')), 'seconds') AS t FROM events", "SELECT event_id, CAST((285 + user_id % 30) * 31536000 AS DOUBLE) AS s, CAST(sign(15 - user_id % 30) AS INT) AS c, -(285 + user_id % 30) * 31536000 - 1 AS t FROM events")

# ---------------------------------------------------------------- decimals, bigints, uuids M1-M10
_sql("m1_decimal", "SELECT event_id, CAST(xd_decimal(concat(CAST(value AS DECIMAL(18,2)), 'm')) AS DOUBLE) AS x, xd_is_decimal('1.5m') AS ok, xd_is_decimal('x') AS bad FROM events", "SELECT event_id, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS x, true AS ok, false AS bad FROM events")
_sql("m2_arithmetic", "SELECT event_id, CAST(xd_decimal('0.1') + xd_decimal('0.2') AS DOUBLE) AS s, CAST(xd_decimal(CAST(user_id AS STRING)) % 7 AS INT) AS r FROM events", "SELECT event_id, CAST(0.3 AS DOUBLE) AS s, CAST(user_id % 7 AS INT) AS r FROM events")
_sql("m3_compare", "SELECT count(*) AS n FROM events WHERE xd_decimal(concat(user_id, '.00m')) = xd_decimal(concat(user_id, 'm')) AND xd_decimal(CAST(user_id AS STRING)) < 50", "SELECT count(*) AS n FROM events WHERE user_id < 50")
_sql("m5_round", "SELECT event_id, CAST(xd_round(CAST(value AS DECIMAL(38,10)), 1, 'floor') AS DOUBLE) AS f, CAST(xd_round(CAST(user_id AS DECIMAL(38,10)) / 10, 0, 'ceil') AS BIGINT) AS c FROM events", "SELECT event_id, CAST(floor(CAST(value AS DECIMAL(38,10)) * 10) / 10 AS DOUBLE) AS f, (user_id + 9) // 10 AS c FROM events")
_X = "CAST(concat('1234567890123456', lpad(event_id % 1000, 3, '0'), '.1', event_id % 10) AS DECIMAL(38,10))"
_sql("m5_round_exact", f"SELECT event_id, CAST(xd_round({_X}, 1, 'floor') AS STRING) AS f, CAST(xd_round({_X}, 1, 'half') AS STRING) AS h, CAST(xd_round(-{_X}, 1, 'floor') AS STRING) AS m FROM events", "SELECT event_id, '1234567890123456' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || '.1000000000' AS f, '1234567890123456' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || CASE WHEN event_id % 10 >= 5 THEN '.2000000000' ELSE '.1000000000' END AS h, '-1234567890123456' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || CASE WHEN event_id % 10 > 0 THEN '.2000000000' ELSE '.1000000000' END AS m FROM events")
_sql("m2_34_digits", "SELECT event_id, xd_decimal_fixed(xd_decimal_calc(concat(event_id, 'e-20m'), 'add', concat(event_id, 'e-20')), 25) AS s, xd_decimal_calc(concat(user_id, '.50'), 'subtract', '0.25') AS d, xd_decimal_calc(concat('1', lpad(user_id, 9, '0'), '00000000000000000000'), 'multiply', '10.0') AS p, xd_decimal_calc(CAST(user_id * 4 AS STRING), 'divide', '8') AS q, xd_decimal_calc(CAST(user_id AS STRING), 'remainder', '7') AS r, xd_decimal_calc('1', 'divide', '0') AS none FROM events", "SELECT event_id, '0.' || lpad(CAST(2 * event_id AS VARCHAR), 20, '0') || '00000' AS s, user_id || '.25' AS d, '1' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '000000000000000000000.0' AS p, CASE WHEN user_id % 2 = 0 THEN CAST(user_id // 2 AS VARCHAR) ELSE user_id // 2 || '.5' END AS q, CAST(user_id % 7 AS VARCHAR) AS r, CAST(NULL AS VARCHAR) AS none FROM events")
_sql("m3_tiny", "SELECT event_id, xd_decimal_cmp(concat(user_id, 'e-30m'), '50e-30') AS c, xd_decimal_cmp(concat(user_id, '.00'), CAST(user_id AS STRING)) AS same FROM events", "SELECT event_id, CAST(sign(user_id - 50) AS INT) AS c, CAST(0 AS INT) AS same FROM events")
_sql("m4_sign", "SELECT event_id, xd_decimal_abs(concat('-', CAST(value AS DECIMAL(18,2)))) AS a, xd_decimal_negate(concat(CAST(value AS DECIMAL(18,2)), 'm')) AS n, xd_decimal_sign(concat(user_id - 20, '.0')) AS s FROM events", "SELECT event_id, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS a, '-' || CAST(value AS DECIMAL(18,2)) AS n, CAST(sign(user_id - 20) AS INT) AS s FROM events")
_sql("m6_formats", "SELECT event_id, xd_decimal_fixed(concat(user_id, '.5m'), 3) AS f, xd_decimal_precision(concat('1', lpad(user_id, 9, '0'), '.25'), 12) AS p, xd_decimal_round(concat(user_id, '.5'), 0, 'half') AS h, xd_decimal_round(concat(user_id, '.5'), 0, 'even') AS e FROM events", "SELECT event_id, user_id || '.500' AS f, '1' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '.25' AS p, CAST(user_id + 1 AS VARCHAR) AS h, CAST((user_id + 1) // 2 * 2 AS VARCHAR) AS e FROM events")
_sql("m7_bigint", "SELECT event_id, CAST(xd_bigint(concat(event_id, '000000000000000000n')) AS STRING) AS x FROM events", "SELECT event_id, CASE WHEN event_id = 0 THEN '0' ELSE event_id || '000000000000000000' END AS x FROM events")
_sql("m8_m9_uuids", "SELECT count(*) AS n, count(DISTINCT a) AS a FROM (SELECT xd_uuid4() AS a, xd_uuid7(timestamp_seconds(1704067200 + event_id)) AS b FROM events) WHERE xd_uuid_version(a) = 4 AND xd_uuid_version(b) = 7", "SELECT count(*) AS n, count(*) AS a FROM events")
_sql("m10_uuid_bytes", "SELECT event_id, xd_uuid_text(xd_uuid_bytes(upper(concat('550e8400-e29b-41d4-a716-', lpad(event_id, 12, '0'))))) AS u, xd_is_uuid('550e8400e29b41d4a716446655440000') AS bad FROM events", "SELECT event_id, '550e8400-e29b-41d4-a716-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS u, false AS bad FROM events")


# ---------------------------------------------------------------- index G1-G5


def _indexed(spark):
    d = spark.table("docs").select("event_id", "v", call("from_navigable", F.to_json("v")).alias("d"))
    return d, pathindex.build(d, "event_id", "d")


@_py("SELECT path, count(*) AS n FROM (SELECT unnest(['id', 'type', 'value', 'user', 'props', 'props.k', 'tags', 'at', 'price', 'took']) AS path FROM events UNION ALL SELECT 'even' FROM events WHERE user_id % 2 = 0) GROUP BY 1")
def g1_paths(spark):
    return _indexed(spark)[1].groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@_py("SELECT event_id FROM events WHERE user_id % 2 = 0 AND event_type = 'click'")
def g3_indexed_contains(spark):
    d, index = _indexed(spark)
    return pathindex.where_contains(d, index, "event_id", "v", "{even: null, type: 'click'}").select("event_id")


@_py("SELECT event_id FROM events WHERE user_id % 2 = 0")
def g5_indexed_exists(spark):
    d, index = _indexed(spark)
    return pathindex.where_exists(d, index, "event_id", "v", ["even", "type"]).select("event_id")


# ---------------------------------------------------------------- sources and streams S1-S13


def _place(spark, name: str) -> str:
    """A new folder on shared storage; a temporary one serves on one machine only."""
    import tempfile
    import uuid

    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{at or tempfile.gettempdir()}/xdoc-{name}-{uuid.uuid4().hex}"


def _written(spark, name: str) -> str:
    path = _place(spark, name)
    broken = F.when(F.col("event_id") % 100 == 0, "oops {").otherwise(F.regexp_replace("t", "^// event\n", ""))
    spark.table("texts").select(broken.alias("value")).write.text(path)
    return path


@_py("SELECT event_id % 100 = 0 AS bad, count(*) AS n FROM events GROUP BY 1")
def s1_lines(spark):
    return lines.read(spark, _written(spark, "lines")).groupBy(F.col("_error").isNotNull().alias("bad")).agg(F.count(F.lit(1)).alias("n"))


@_py("SELECT event_type AS t, count(*) AS n FROM events WHERE event_id % 100 <> 0 GROUP BY 1")
def s3_file_numbers(spark):
    got = lines.read(spark, _written(spark, "numbered"), mode="DROPMALFORMED", line_numbers=True)
    v = F.parse_json(call("navigable", F.col("document")))
    return got.where("_line_number > 0").groupBy(call("field_text", v, "type").alias("t")).agg(F.count(F.lit(1)).alias("n"))


@_py("SELECT event_id, '{id:' || event_id || 'n}' AS value FROM events")
def s5_stringify(spark):
    d = spark.table("events").select("event_id", call("parse", F.concat(F.lit("{\"id\": "), F.col("event_id"), F.lit("n}"))).alias("document"))
    return d.select("event_id", call("stringify", F.col("document")).alias("value"))


@_py("SELECT event_type AS key, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events WHERE event_id % 100 <> 0 GROUP BY 1")
def s14_stream_totals(spark):
    """A stream of text lines to running totals per key."""
    import uuid

    source = lines.read_stream(spark, _written(spark, "stream"), mode="DROPMALFORMED")
    totals = streaming.totals(source.withColumn("v", F.parse_json(call("navigable", F.col("document")))), "type", "price")
    name = f"xdoc_totals_{uuid.uuid4().hex}"
    query = totals.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select("key", "n", F.col("total").cast("double").alias("total"))


@_py("SELECT '{id:' || event_id || 'n}' AS value FROM events")
def s6_sink(spark):
    """Documents written as lines, read back as text."""
    at = _place(spark, "sink")
    lines.write(spark.table("events").select(call("parse", F.concat(F.lit('{"id": '), "event_id", F.lit("n, }"))).alias("document")), at)
    return spark.read.text(at)


@_py("SELECT event_id // 1000 AS k, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def s13_whole_documents(spark):
    """One document per file, over many lines each."""
    at = _place(spark, "whole")
    some = spark.table("events").groupBy(F.expr("event_id div 1000").alias("k")).agg(F.collect_list(F.concat(F.col("event_id").cast("string"), F.lit("n"))).alias("ids"))
    one = F.concat(F.lit("{ // a thousand events\n  k: "), F.col("k"), F.lit(",\n  ids: ["), F.array_join("ids", ",\n"), F.lit("],\n}"))
    some.select(one.alias("value")).write.option("maxRecordsPerFile", 1).text(at)
    got = lines.read_whole(spark, at).select(F.parse_json(call("navigable", F.col("document"))).alias("v"))
    got = got.select(F.try_variant_get("v", "$.k", "bigint").alias("k"), call("elements", call("field", F.col("v"), "ids")).alias("ids"))
    got = got.select("k", F.explode("ids").alias("e")).select("k", call("numeric", F.col("e")).cast("bigint").alias("e"))
    return got.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("ids"))


@_py("SELECT 'unexpected_token' AS code, 'oops {' AS line, count(*) AS n FROM events WHERE event_id % 100 = 0 UNION ALL SELECT NULL, NULL, count(*) FROM events WHERE event_id % 100 <> 0")
def s17_stream_quarantine(spark):
    """Bad lines of a stream, beside its documents."""
    import uuid

    source = lines.read_stream(spark, _written(spark, "errors"))
    name = f"xdoc_errors_{uuid.uuid4().hex}"
    counted = source.groupBy(F.col("_error.code").alias("code"), F.col("_line").alias("line")).agg(F.count(F.lit(1)).alias("n"))
    counted.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@_py("SELECT event_id, event_id % 100 = 0 AS bad, CASE WHEN event_id % 100 <> 0 THEN '{id:' || event_id || 'n}' END AS t FROM events")
def s2_transform(spark):
    """Lines of any frame, its other columns kept."""
    text = F.when(F.col("event_id") % 100 == 0, "oops {").otherwise(F.concat(F.lit("{id: "), "event_id", F.lit("n}")))
    got = lines.parse_lines(spark.table("events").select("event_id", text.alias("value")))
    return got.select("event_id", F.col("_error").isNotNull().alias("bad"), call("stringify", F.col("document")).alias("t"))


@_py("SELECT event_id, '{nan:null,x:' || CASE WHEN user_id % 2 = 0 THEN 'null' ELSE '1.5' END || '}' AS t FROM events")
def c7_not_finite(spark):
    df = spark.table("events").select("event_id", F.lit(float("nan")).alias("nan"), F.when(F.col("user_id") % 2 == 0, float("-inf")).otherwise(1.5).alias("x"))
    return df.select("event_id", call("stringify", construct.row_document(df, "nan", "x")).alias("t"))


@_py("SELECT event_id, event_id % 2 = 0 AS strict, '{' || chr(10) || '  ''id'': ' || event_id || chr(10) || '}' AS t FROM events")
def c10_presets(spark):
    """A parser and a writer under options of their own."""
    from ..functions.codec import parser, writer
    from ..text import ParseOptions

    strict, pretty = parser(ParseOptions(trailing_commas=False, comments=False), attempt=True), writer(WriteOptions(indent=2, quote_keys=True))
    text = F.concat(F.lit("{id: "), "event_id", F.when(F.col("event_id") % 2 == 0, "}").otherwise(",}"))
    return spark.table("events").select("event_id", strict(text).isNotNull().alias("strict"), pretty(call("parse", text)).alias("t"))


@_py("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'depth' WHEN event_id % 3 = 0 THEN 'string_length' END AS code FROM events")
def c16_limits(spark):
    from ..text import ParseOptions

    text = F.when(F.col("event_id") % 2 == 0, "[[[[1]]]]").when(F.col("event_id") % 3 == 0, "'abcdef'").otherwise("[['abcde']]")
    return spark.table("events").select("event_id", lines.attempt(ParseOptions(max_depth=3, max_string=5))(text)["code"].alias("code"))


@_py("SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM (SELECT *, sum(CASE WHEN since < INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS since FROM events)) GROUP BY user_id, s")
def s16_sessions(spark):
    """Sessions of a user's events over an instant member; beyond the reference."""
    user = F.try_variant_get(call("field", F.col("v"), "user"), "$", "bigint").alias("user_id")
    return streaming.sessions(spark.table("docs").select("v"), "at", "6 hours", "10 minutes", user).select("user_id", F.unix_micros(F.col("session_window.start")).alias("start_us"), "n")


@_py("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS day_us, count(*) AS n FROM events GROUP BY 1")
def s15_windows(spark):
    """Tumbling windows over an instant member; beyond the reference."""
    return streaming.windows(spark.table("docs").select("v"), "at", "1 day").select(F.unix_micros(F.col("window.start")).alias("day_us"), "n")


# ---------------------------------------------------------------- bench shapes
_sql("bench_top_filtered", "SELECT event_id, xd_path_text(v, array('props', 'k')) AS k FROM docs WHERE xd_field_text(v, 'type') = 'click' AND try_variant_get(xd_field(v, 'value'), '$', 'double') > 20 ORDER BY event_id DESC LIMIT 10", "SELECT event_id, CAST(CAST(props->>'k' AS BIGINT) AS VARCHAR) AS k FROM events WHERE event_type = 'click' AND value > 20 ORDER BY event_id DESC LIMIT 10")


@_py("SELECT o_orderkey, n, same FROM (SELECT o_orderkey, count(l_orderkey) AS n, true AS same FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)")
def bench_round_trip(spark):
    """Every order with its lines as a nested document, through text and binary and back."""
    li = spark.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    gathered = li.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice")).alias("lines"))
    o = spark.table("orders").join(gathered.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")  # both sides grow, so neither is broadcast; the gathered one is dealt by its key already
    o = o.select("o_orderkey", "o_totalprice", "o_orderstatus", F.coalesce("lines", F.array().cast("array<struct<l_linenumber:int,l_quantity:double,l_extendedprice:double>>")).alias("lines"))
    return o.select("o_orderkey", F.size("lines").cast("long").alias("n"), call("round_trips", construct.row_document(o)).alias("same"))
