import duckdb
import pytest
from pyspark.sql import functions as F

import xdoc
from xdoc.operators import construct, pathindex
from xdoc.operators.containment import contains
from xdoc.plans import queries as plans
from xdoc.sources import datasource, lines
from xdoc.streaming import events

SF = "/root/testdata/sf0.001"


def _rows(frame):
    names = sorted(frame.columns)
    return sorted(tuple(str(v) for v in r) for r in frame[names].convert_dtypes().astype(object).where(frame[names].notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for table in (*plans.TABLES, "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = plans.QUERIES[name](spark, SF).toPandas(), con.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def _one(spark, sql):
    xdoc.register(spark)
    return spark.sql(f"SELECT {sql}").first()


def test_flagship_has_no_python(spark):
    plan = plans.flagship(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    plans.open_views(spark, SF)
    plan = spark.sql("SELECT xd_path_text(v, array('tags', '1')) FROM docs WHERE xd_exists(v, 'even')")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_nulls_give_nulls(spark):
    names = ["xd_parse(CAST(NULL AS STRING))", "xd_stringify(CAST(NULL AS BINARY))", "xd_field(CAST(NULL AS VARIANT), 'a')", "xd_typeof(CAST(NULL AS VARIANT))", "xd_instant(CAST(NULL AS STRING))", "xd_exists(CAST(NULL AS VARIANT), 'a')", "xd_array_length(CAST(NULL AS VARIANT))"]
    assert list(_one(spark, ", ".join(names))) == [None] * len(names)


def test_special_keys(spark):
    row = _one(spark, """xd_field_text(v, 'a.b'), xd_field_text(v, ''), xd_field_text(v, '$x'), xd_exists(v, '$n'), xd_field_text(v, 'q"r') FROM (SELECT parse_json(xd_navigable(xd_parse('{"a.b": 1, "": 2, "$x": 3, \\'q"r\\': 4}'))) AS v)""")
    assert list(row) == ["1", "2", "3", False, "4"]


def test_temporal(spark):
    row = _one(spark, "xd_instant_text(xd_instant_plus(xd_instant('2025-01-01T00:00:00.999999999+05:30'), xd_duration('PT0.000000001S'))), xd_duration_text(xd_duration('-P1Y2M3DT4H5M6.789S')), xd_duration('PT') IS NULL, xd_instant('2024-13-01T00:00:00Z') IS NULL, xd_instant_text(xd_instant('1969-12-31T23:59:59.5Z')), xd_duration_cmp(xd_duration('PT60M'), xd_duration('PT1H')), xd_instant_cmp(xd_instant('2025-01-01T05:30:00+05:30'), xd_instant('2025-01-01T00:00:00Z'))")
    assert list(row) == ["2025-01-01T00:00:01.000000000+05:30", "-P1Y2M3DT4H5M6.789000000S", True, True, "1969-12-31T23:59:59.500000000Z", 0, 0]


def test_errors_of_lengths_and_keys(spark):
    for bad in ("xd_array_length(parse_json('{}'))", "xd_keys(parse_json('[]'))", "xd_parse('{')"):
        with pytest.raises(Exception):
            _one(spark, bad)
    assert _one(spark, "xd_try_parse('{')")[0] is None


@pytest.mark.parametrize("doc", ["{a:1}", "{a:{b:'x'}}", "{t:[1,null]}", "{}", "{n:5n}", "{a:[]}", "[1]", "{m:1.50m}", "{a:null}", "{t:[{k:1}]}"])
def test_compiled_containment_is_the_general_one(spark, doc):
    xdoc.register(spark)
    texts = ["{a:1,n:5n}", "{a:{b:'x',c:2},m:1.50m}", "{t:[1,2,null,{k:1}],a:null}", "{}", "[1,2]", "1", "{a:[],m:1.5m}", "null", "{a:1.0,n:5}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("d", xdoc.call("parse", F.col("t"))).withColumn("v", xdoc.document(F.col("d")))
    rows = df.select(contains("v", doc).alias("a"), xdoc.call("contains", F.col("d"), xdoc.call("parse", F.lit(doc))).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def test_aggregates_of_nothing_and_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), (None, 3), ("a", 4)], "k string, x int")
    pick = lambda d: d.agg(construct.array_agg(construct.typed(df, "x")).alias("a"), construct.object_agg(F.col("k"), construct.typed(df, "x")).alias("o")).first()
    assert pick(df.limit(0)).a == "[]" and pick(df.limit(0)).o == "{}"
    assert pick(df.coalesce(1)).a == "[1,3,4]" and pick(df.coalesce(1)).o == '{"a":4}'


def test_constructors(spark):
    df = spark.createDataFrame([(True, 1, 2**40, 1.5, "x", None)], "b boolean, i int, l long, d double, s string, n string")
    v = df.select(construct.from_row(df).alias("v"), construct.from_row(df, omit_empty=True).alias("w"))
    row = v.select(F.to_json("v"), F.to_json("w")).first()
    assert row[0] == '{"b":true,"d":1.5,"i":1,"l":{"$n":"1099511627776"},"n":null,"s":"x"}'
    assert row[1] == '{"b":true,"d":1.5,"i":1,"l":{"$n":"1099511627776"},"s":"x"}'
    with pytest.raises(ValueError):
        construct.build_object(df, "a")


def test_index_filters_and_rechecks(spark):
    xdoc.register(spark)
    df = spark.createDataFrame([(1, "{a:{b:1}}"), (2, "{b:1}"), (3, "{'a.b':1}"), (4, "{a:{b:2},c:3}")], "id int, t string").withColumn("d", xdoc.call("parse", F.col("t"))).withColumn("v", xdoc.document(F.col("d")))
    index = pathindex.build(df, "id", "d")
    assert [r.id for r in pathindex.where_contains(df, index, "id", "v", "{a:{b:1}}").collect()] == [1]
    assert sorted(r.id for r in pathindex.where_exists(df, index, "id", "v", ["a"]).collect()) == [1, 4]
    assert sorted(r.id for r in pathindex.where_exists(df, index, "id", "v", ["b", "c"], any_=True).collect()) == [2, 4]


def test_line_modes(spark, tmp_path):
    xdoc.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("{a:1}\n\n   \noops {\n{a:2n}\n\"long " + "x" * 200 + "\"\n{a:3}")
    src = str(tmp_path / "in")
    got = lines.read(spark, src, line_numbers=True, max_line=100)
    good, bad = lines.quarantine(got)
    assert sorted(r._line_number for r in good.collect()) == [1, 5, 7]
    assert sorted((r._line_number, r._error.code) for r in bad.collect()) == [(4, "unexpected_token"), (6, "line_length")]
    assert lines.read(spark, src, mode="DROPMALFORMED").count() == 4
    with pytest.raises(Exception, match="Parse error on line 4"):
        lines.read(spark, src, mode="FAILFAST", line_numbers=True).collect()
    lines.write(good, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["{a:1}", "{a:2n}", "{a:3}"]
    datasource.register(spark)
    table = spark.read.format("xdocl").option("skipInvalid", "true").load(src)
    assert sorted(r.line_number for r in table.where("error IS NULL").collect()) == [1, 5, 6, 7]
    table.where("document IS NOT NULL").write.format("xdocl").mode("append").save(str(tmp_path / "again"))
    assert spark.read.format("xdocl").load(str(tmp_path / "again")).count() == 4
    table.where("line_number = 1").write.format("xdocl").mode("overwrite").save(str(tmp_path / "again"))
    assert spark.read.format("xdocl").load(str(tmp_path / "again")).count() == 1
    broken = table.where("document IS NOT NULL").select(F.when(F.col("line_number") == 1, F.lit(b"\xff")).otherwise(F.col("document")).alias("document"), "line_number", "error", "line")
    with pytest.raises(Exception):
        broken.write.format("xdocl").mode("append").save(str(tmp_path / "again"))
    assert len([p for p in (tmp_path / "again").iterdir() if p.name.startswith(".part")]) == 0
    assert spark.read.format("xdocl").load(str(tmp_path / "again")).count() == 1
    broken.write.format("xdocl").mode("append").option("skipInvalid", "true").save(str(tmp_path / "again"))
    assert spark.read.format("xdocl").load(str(tmp_path / "again")).count() == 4


def test_streams(spark, tmp_path):
    xdoc.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("".join(f"{{s: 'k{i % 2}', x: {i}m, t: 2025-01-01T00:{i:02d}:00Z}}\n" for i in range(20)))
    docs = lines.read_stream(spark, str(tmp_path / "in"), mode="DROPMALFORMED").withColumn("v", F.parse_json(xdoc.call("navigable", F.col("document"))))
    for name, frame, mode in (("t1", events.totals(docs, "s", "x"), "complete"), ("t2", events.windows(docs, "t", "10 minutes"), "complete"), ("t3", events.sessions(docs, "t", "5 minutes", "10 minutes", xdoc.call("typeof", F.col("v")).alias("k")), "complete")):
        frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.key, r.n, int(r.total)) for r in spark.table("t1").collect()) == [("k0", 10, 90), ("k1", 10, 100)]
    assert sorted(r.n for r in spark.table("t2").collect()) == [10, 10] and [r.n for r in spark.table("t3").collect()] == [20]
    lines.write_stream(docs, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.text(str(tmp_path / "out")).count() == 20


def test_wide_ranges(spark):
    row = _one(spark, "xd_seconds(xd_duration('P300Y')), xd_approx_ns(xd_duration('P300Y')), xd_instant('9999-01-01T00:00:00Z'), xd_instant('0001-01-01T00:00:00Z'), xd_instant_text(xd_instant('2262-01-01T00:00:00Z')), xd_total(xd_duration('P1000Y'), 'days'), xd_instant_plus(xd_instant('2025-01-01T00:00:00Z'), xd_duration('P500Y')), xd_is_negative(xd_duration('-P9999Y'))")
    assert list(row) == [9460800000.0, None, None, None, "2262-01-01T00:00:00.000000000Z", 365000, None, True]


@pytest.mark.parametrize("mode, want", [("floor", "-2.6 2.5 -3 2"), ("ceil", "-2.5 2.6 -2 3"), ("trunc", "-2.5 2.5 -2 2"), ("even", "-2.6 2.6 -2 2"), ("half", "-2.6 2.6 -3 3")])
def test_rounding(spark, mode, want):
    row = _one(spark, f"xd_round(-2.55BD, 1, '{mode}'), xd_round(2.55BD, 1, '{mode}'), xd_round(-2.5BD, 0, '{mode}'), xd_round(2.5BD, 0, '{mode}'), xd_round(0.0000000001BD, 12, '{mode}'), xd_round(-155BD, -1, '{mode}')")
    assert [float(x) for x in row[:4]] == [float(x) for x in want.split()] and float(row[4]) == 1e-10
    assert int(row[5]) == {"floor": -160, "ceil": -150, "trunc": -150, "even": -160, "half": -160}[mode]


def test_decimals_keep_every_digit(spark):
    got = _one(spark, "xd_decimal_calc('100', 'divide', '3'), xd_decimal_calc('0.1', 'add', '0.2'), xd_decimal_calc('19.99', 'multiply', '3'), xd_decimal_abs('-1e-30m'), xd_decimal_fixed('1e-30', 32), xd_decimal_precision('3.14159', 3), xd_decimal_round('-2.5', 0, 'floor')")
    assert list(got) == ["33." + "3" * 32, "0.3", "59.97", "1e-30", "0." + "0" * 29 + "100", "3.14", "-3"]
    assert list(_one(spark, "xd_decimal_cmp('0.00000000001m', '0m'), xd_decimal_calc('1', 'divide', '0'), xd_decimal_calc('x', 'add', '1'), xd_decimal_calc('1', 'no', '1'), xd_decimal_abs(CAST(NULL AS STRING)), xd_decimal_abs('1e7000')")) == [1, None, None, None, None, None]


def test_times_keep_their_microseconds(spark):
    xdoc.register(spark)
    df = spark.createDataFrame([(1704251028465744999,), (-1,)], "ns long").select(F.parse_json(F.concat(F.lit('{"at":{"$i":'), "ns", F.lit("}}"))).alias("v"))
    assert [r.us for r in events.event_time(df, "at").select(F.unix_micros("event_time").alias("us")).collect()] == [1704251028465744, -1]


def test_members_set_and_appended(spark):
    got = _one(spark, "xd_decode(xd_with_member(xd_parse('{a:1,b:2}'), 'a', xd_parse('3n'))), xd_decode(xd_appended(xd_parse('[]'), xd_parse('{}'))), xd_stored_keys(xd_parse('{z:1,a:2}')), xd_appended(xd_parse('[]'), CAST(NULL AS BINARY))")
    assert list(got) == ["{a:3n,b:2}", "[{}]", ["z", "a"], None]


def test_doubles_of_documents_are_plain_casts(spark):
    xdoc.register(spark)
    from xdoc.operators import construct

    df = spark.createDataFrame([(x,) for x in (0.5, 17.0, -0.0, 1e21, 1e-7, 1.7976931348623157e308, 4.9e-324, float("nan"), None)], "x double")
    d = construct.row_document(df)
    assert "to_variant_object" not in df.select(d)._jdf.queryExecution().analyzed().toString()
    assert [r[0] for r in df.select(xdoc.call("stringify", d)).collect()] == ["{x:0.5}", "{x:17}", "{x:-0}", "{x:1e21}", "{x:1e-7}", "{x:1.7976931348623157e308}", "{x:5e-324}", "{x:null}", "{x:null}"]


def test_index_takes_one_shuffle_by_key(spark):
    xdoc.register(spark)
    from xdoc.operators import pathindex

    d = spark.range(20).select("id", xdoc.call("parse", F.concat(F.lit("{a:1"), F.when(F.col("id") % 2 == 0, ",b:{c:2}").otherwise(""), F.lit("}"))).alias("d"))
    index = pathindex.build(d, "id", "d")
    for wanted, any_, n in ((["a", "b.c"], False, 10), (["b", "b"], False, 10), (["b", "x"], False, 0), (["b", "x"], True, 10), ([], False, 20)):
        assert pathindex.with_paths(d, index.union(index), "id", wanted, any_).count() == n
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pathindex.with_paths(d, index, "id", ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 2  # before: 3


def test_events_are_dealt_evenly(spark):
    from xdoc.plans import queries

    queries.open_views(spark, "/root/testdata/sf0.001")  # one row group: one task before
    assert spark.table("docs").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_numbered_lines_of_split_files(spark, tmp_path):
    xdoc.register(spark)
    src = tmp_path / "a b+c"
    src.mkdir()
    lines_ = {f"f%{k}.txt": [b"" if n % 7 == 0 else b"{n:%d}" % n for n in range(1, size + 1)] for k, size in enumerate((3000, 1, 900))}
    for name, rows in lines_.items():
        (src / name).write_bytes(b"\n".join(rows) + b"\n\n")
    (src / "bad.txt").write_bytes(b"\n'\xff'")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = lines.read(spark, str(src), mode="FAILFAST", line_numbers=True)
        assert got.rdd.getNumPartitions() > 4  # before: a file was one task's work
        rows = got.select("_file", "_line_number", xdoc.call("stringify", F.col("document")).alias("t")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    expected = {(f"file:{src}/{name}", n, row.decode()) for name, rows in lines_.items() for n, row in enumerate(rows, 1) if row}
    assert {tuple(r) for r in rows} == expected | {(f"file:{src}/bad.txt", 2, "'�'")} and len(rows) == len(expected) + 1
