import contextlib
import io
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lakeweave.bootstrap import bootstrap
from lakeweave.functions import register_functions, shard_by_remainder, strftime
from lakeweave.operators.joins import not_in, range_join
from lakeweave.plans.classify import classify, stripped
from lakeweave.plans.ssb import Star
from lakeweave.plans.tpch import TPCH
from lakeweave.session import Engine, Settings, plan_distribution, summarize
from lakeweave.shell import Shell
from lakeweave.sources.catalog import Tables, export, register, register_arrow
from lakeweave.sources.shards import ORDERS_TREE, SHARD, STAR_TREE, ShardTable, Shards, build_shards, sharded, verify_shards
from lakeweave.streaming import windowed
from lakeweave.users import authenticate, create_user


@pytest.fixture(scope="module")
def engine(spark, small, tmp_path_factory):
    return bootstrap(spark, small, str(tmp_path_factory.mktemp("shards")), shards=4)


AGGREGATE = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"


@pytest.mark.parametrize(
    ("text", "query", "aggregates"),
    [
        (AGGREGATE, True, True),
        ("SELECT sum(o_totalprice) / count(*) FROM orders HAVING count(*) > 0 ORDER BY 1 LIMIT 1;", True, True),
        ("SELECT o_orderkey FROM orders", True, False),
        ("SELECT DISTINCT o_custkey FROM orders", True, False),
        ("SELECT o_custkey FROM orders GROUP BY o_custkey", True, False),
        ("SELECT sum(o_totalprice) OVER () FROM orders", True, False),
        ("SELECT n FROM (SELECT count(*) AS n FROM orders) t", True, False),
        ("WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT sum(n) FROM a", True, True),
        ("WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT n FROM a", True, False),
        ("SELECT 1 UNION SELECT 2", True, False),
        ("DROP TABLE orders", False, False),
        ("EXPLAIN SELECT 1", False, False),
        ("SET a = 1", False, False),
        ("CREATE TABLE x AS SELECT 1", False, False),
        ("SELECT FROM WHERE", False, False),
    ],
)
def test_classify(spark, small, text, query, aggregates):
    register(spark, small)
    kind = classify(spark, text)
    assert (kind.is_query, kind.has_aggregates) == (query, aggregates)
    assert bool(kind.problem) != query


def test_terminators():
    assert stripped("  SELECT 1 ;\n/\n") == "SELECT 1" == stripped("SELECT 1")


@pytest.mark.parametrize(
    ("mode", "aggregates", "shards", "expected", "n_reasons"),
    [("TRUE", True, 3, "shards", 0), ("TRUE", False, 3, "whole", 1), ("FALSE", True, 3, "whole", 1), ("FALSE", False, 0, "whole", 3), ("FORCE", False, 3, "shards", 0), ("FORCE", True, 0, "whole", 1)],
)
def test_plan_distribution(mode, aggregates, shards, expected, n_reasons):
    how, reasons = plan_distribution(Settings(distributed=mode), aggregates, shards)
    assert (how, len(reasons)) == (expected, n_reasons)


def test_settings():
    s = Settings()
    s.set("distributed", "force")
    s.set("summarize", "nonsense")
    s.set("active_shards", "3,1")
    s.set("max_rows", "7")
    assert (s.distributed, s.summarize, s.active_shards, s.max_rows) == ("FORCE", False, [1, 3], 7)
    assert s.show("active_shards") == "1,3"
    assert "max_rows = 7" in s.show()
    for bad in (("distributed", "maybe"), ("colour", "red")):
        with pytest.raises(ValueError):
            s.set(*bad)
    with pytest.raises(ValueError):
        s.show("colour")


def test_each_order_in_one_shard(spark, small):
    t = Tables(spark, small)
    dealt = sharded(lambda name: getattr(t, name), ORDERS_TREE, 5)
    assert dealt["orders"].count() == t.orders.count() == dealt["orders"].select("o_orderkey").distinct().count()
    assert dealt["lineitem"].count() == t.lineitem.count()
    assert SHARD not in dealt["nation"].columns
    lost = dealt["lineitem"].join(dealt["part"].withColumnRenamed("p_partkey", "l_partkey"), ["l_partkey", SHARD], "left_anti")
    assert lost.count() == 0
    sizes = [r["count"] for r in dealt["orders"].groupBy(SHARD).count().collect()]
    assert len(sizes) == 5 and max(sizes) < 2 * min(sizes)


def test_build_and_verify(spark, small, tmp_path):
    t = Tables(spark, small)
    read = lambda name: getattr(t, name)
    path = str(tmp_path / "s")
    build_shards(spark, read, ORDERS_TREE, 4, path, first=2, last=3, deal=shard_by_remainder)
    shards = Shards(spark, path)
    assert shards.numbers == [2, 3]
    assert {r["m"] for r in shards.table("orders", 2).selectExpr("o_custkey % 4 AS m").distinct().collect()} == {1}
    assert SHARD not in shards.table("orders", 2).columns
    assert verify_shards(spark, path) == []
    with pytest.raises(Exception, match="(?i)exists"):
        build_shards(spark, read, ORDERS_TREE, 4, path)
    spark.read.parquet(f"{path}/part").where("p_partkey > 3").write.partitionBy(SHARD).parquet(f"{path}/other")
    shutil.rmtree(f"{path}/part")
    shutil.move(f"{path}/other", f"{path}/part")
    assert {w.split(",")[0] for w in verify_shards(spark, path)} == {"part"}
    with pytest.raises(ValueError):
        build_shards(spark, read, (ShardTable("nation"),), 4, path, first=3, last=9)


def test_engine_is_exact_by_default(engine, spark):
    run = engine.sql(AGGREGATE + ";")
    assert run.mode == "shards" and run.reasons == []
    table = run.arrow()
    assert run.status == "COMPLETED" and sum(table.column("n").to_pylist()) == 1500
    whole = engine.sql("SELECT c_custkey FROM customer")
    assert whole.mode == "whole" and "no aggregates" in whole.notice()
    bad = engine.sql("DELETE FROM orders")
    assert bad.status == "FAILED" and bad.df is None


def test_results_by_shard(engine):
    try:
        engine.settings.set("summarize", "false")
        parts = engine.sql(AGGREGATE).df
        assert SHARD in parts.columns and parts.count() > 4
        summed = summarize(parts, ["o_orderstatus"], {"n": "count"}).agg({"n": "sum"}).first()[0]
        assert summed == 1500
        engine.settings.set("active_shards", "1,2")
        some = engine.sql(AGGREGATE).df
        assert {r[SHARD] for r in some.collect()} == {1, 2}
        engine.settings.set("active_shards", "all")
        engine.settings.set("distributed", "force")
        forced = engine.sql("SELECT count(*) AS n FROM nation").df
        assert [r["n"] for r in forced.collect()] == [25] * 4
    finally:
        engine.settings = Settings()
    # the views are the whole tables again
    assert engine.spark.sql("SELECT count(*) FROM orders").first()[0] == 1500


def test_active_shards_narrow_what_is_summed(engine, spark):
    try:
        engine.settings.set("active_shards", "1,3")
        run = engine.sql("SELECT count(*) AS n, count(DISTINCT o_custkey % 10) AS d FROM orders JOIN customer ON c_custkey = o_custkey")
        assert run.mode == "subset" and "active shards" in run.notice()
        held = Shards(spark, engine.shards.path).table("orders").where(f"{SHARD} IN (1, 3)").count()
        assert 0 < held < 1500 and run.df.first()["n"] == held
        lines = engine.sql("SELECT count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey").df.first()["n"]
        assert lines == Shards(spark, engine.shards.path).table("lineitem").where(f"{SHARD} IN (1, 3)").count()
        assert engine.sql("SELECT count(*) AS n FROM nation").df.first()["n"] == 25
    finally:
        engine.settings = Settings()
    assert "exactly" in engine.sql(AGGREGATE).notice()
    # other users of the session see the whole tables
    assert spark.sql("SELECT count(*) FROM orders").first()[0] == 1500


def test_sign_in(spark, small, tmp_path):
    path = str(tmp_path / "users.json")
    create_user(path, "ann", "word", rounds=1000)
    assert Engine(spark, small, user_file=path, token="ann:word").user == "ann"
    for token in ("ann:other", "", "bob:word"):
        with pytest.raises(PermissionError):
            Engine(spark, small, user_file=path, token=token)


def test_tables_of_both_layouts(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "one"))
    spark.range(4).write.parquet(str(tmp_path / "two.parquet"))
    t = Tables(spark, str(tmp_path))
    assert (t.one.count(), t.two.count()) == (3, 4)
    with pytest.raises(AttributeError):
        t.three


def test_tables_see_changed_files(spark, tmp_path):
    for columns in ({"a": [1, 2]}, {"a": [1, 2], "b": ["x", "y"]}, {"b": [1.5, 2.5, 3.5]}):
        pq.write_table(pa.table(columns), str(tmp_path / "one.parquet"))
        for _ in range(2):
            t = Tables(spark, str(tmp_path))
            assert (t.one.columns, t.one.columns, t.one.count()) == (list(columns), list(columns), len(next(iter(columns.values()))))
    assert t.one.schema["b"].dataType.simpleString() == "double"


def test_managed_tables_and_arrow(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "kept_numbers"))
    try:
        assert register(spark, str(tmp_path), materialize=True) == ["kept_numbers"]
        assert spark.catalog.tableExists("kept_numbers") and not spark.catalog._jcatalog.getTable("kept_numbers").isTemporary()
        spark.sql("CREATE TABLE kept_twice USING parquet AS SELECT id * 2 AS id FROM kept_numbers")
        assert spark.table("kept_twice").agg({"id": "sum"}).first()[0] == 20
    finally:
        for name in ("kept_numbers", "kept_twice"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    register_arrow(spark, "from_memory", pa.table({"k": [1, 2, 2], "v": ["a", None, "c"]}))
    assert [tuple(r) for r in spark.sql("SELECT k, count(v) FROM from_memory GROUP BY k ORDER BY k").collect()] == [(1, 1), (2, 1)]


def test_star_shards(spark, small, tmp_path):
    of = Star(Tables(spark, small))
    tables = {"customer": of.people("c"), "lineorder": of.join(), "part": of.parts, "supplier": of.people("s"), "date_dim": of.orders.select("lo_orderdate").distinct()}
    build_shards(spark, tables.__getitem__, STAR_TREE, 3, str(tmp_path / "s"))
    assert verify_shards(spark, str(tmp_path / "s")) == []
    built = Shards(spark, str(tmp_path / "s"))
    assert sum(built.table("lineorder", n).count() for n in built.numbers) == 6000
    some = built.subset(tables.__getitem__, [2])
    assert some["lineorder"].count() == built.table("lineorder", 2).count() and some["part"].count() == built.table("part", 2).count()


def test_strftime_in_sql(spark):
    register_functions(spark)
    row = spark.sql("SELECT strftime('%Y', TIMESTAMP_NTZ'2021-03-04 05:06:07'), strftime(DATE'2021-03-04', '%d.%m.%y'), strftime('%H:%M', CAST(NULL AS TIMESTAMP))").first()
    assert tuple(row) == ("2021", "04.03.21", None)


def test_shell(engine):
    typed = ".show distributed\n.set max_rows=2\n.set nothing\nSELECT r_name\nFROM region ORDER BY 1;\nSELECT 1 AS one\n/\nDROP TABLE x;\nSELECT nope FROM region;\n.quit\n"
    out = io.StringIO()
    Shell(engine, stdout=out, stdin=io.StringIO(typed)).cmdloop()
    text = out.getvalue()
    for expected in ("TRUE", "max_rows is now 2", "Error: use .set", "AFRICA", "only the first 2 rows", "one", "not a SELECT", "failed to analyse: [UNRESOLVED_COLUMN"):
        assert expected in text, text
    assert "ASIA" not in text
    engine.settings = Settings()


def test_users(tmp_path):
    path = tmp_path / "users.json"
    create_user(path, "ann", "a:b", rounds=1000)
    assert authenticate(path, "ann:a:b") == "ann"
    assert authenticate(path, "ann:a") is None
    assert authenticate(path, "bob:a:b") is None
    create_user(path, "ann", "new", rounds=1000)
    assert authenticate(path, "ann:a:b") is None and authenticate(path, "ann:new") == "ann"
    assert "a:b" not in path.read_text()
    with pytest.raises(ValueError):
        create_user(path, "x:y", "p")


def test_catalog(spark, tmp_path, small):
    spark.range(3).write.parquet(str(tmp_path / "date"))
    export(spark.range(2), str(tmp_path / "other"))
    assert register(spark, str(tmp_path)) == ["date_dim", "other"]
    assert spark.sql("SELECT count(*) FROM date_dim").first()[0] == 3
    with pytest.raises(Exception, match="(?i)exists"):
        export(spark.range(2), str(tmp_path / "other"))
    for fmt in ("orc", "csv", "json"):
        spark.range(4).selectExpr("id", "id * 2 AS twice").write.option("header", True).format(fmt).save(str(tmp_path / f"t_{fmt}.{fmt}"))
    with pytest.raises(ValueError, match="schema"):
        register(spark, str(tmp_path))
    names = register(spark, str(tmp_path), schemas=dict.fromkeys(("t_csv", "t_json"), "id long, twice long"))
    assert names == ["date_dim", "other", "t_csv", "t_json", "t_orc"]
    for name in names[2:]:
        assert spark.sql(f"SELECT sum(id), sum(twice) FROM {name}").first()[:] == (6, 12)
    engine = Engine(spark, small)
    assert engine.sql("SELECT count(*) AS n FROM region").reasons == ["no shards are at hand"]


def test_not_in_with_nulls(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    some, null, none = (spark.createDataFrame(x, "x int") for x in ([(2,)], [(2,), (None,)], []))
    assert [r["k"] for r in not_in(rows, "k", some).collect()] == [1]
    assert not_in(rows, "k", null).count() == 0
    assert not_in(rows, "k", none).count() == 3


def test_range_join(spark):
    points = spark.createDataFrame([(0, 0.5), (1, 7.0), (2, 10.0), (3, None)], "id int, at double")
    spans = spark.createDataFrame([("a", 0.0, 10.0), ("b", 7.0, 7.5), ("c", 9.0, 9.0), ("d", 10.0, 31.0)], "name string, lo double, hi double")
    found = {(r["id"], r["name"]) for r in range_join(points, "at", spans, "lo", "hi", width=4.0).collect()}
    assert found == {(0, "a"), (1, "a"), (1, "b"), (2, "d")}


def test_strftime(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2021-03-04 05:06:07' AS t")
    assert df.select(strftime(df.t, "%Y/%m/%d %H:%M:%S at %b")).first()[0] == "2021/03/04 05:06:07 at Mar"
    with pytest.raises(ValueError):
        strftime(df.t, "%Q")


def test_stream_equals_batch(spark, small, tmp_path):
    events = Tables(spark, small).events
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    key = lambda r: (r["start"], r["event_type"], r["n"], round(r["total"], 6))
    assert sorted(map(key, spark.table("hourly").collect())) == sorted(map(key, windowed(events).collect()))


def test_pushdown(spark, small):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        TPCH["tpch_h06"].run(Tables(spark, small)).explain("formatted")
    pushed, read = (next(x for x in out.getvalue().split("\n") if x.startswith(k)) for k in ("PushedFilters", "ReadSchema"))
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThan(l_quantity" in pushed
    assert "l_discount" in read and "l_orderkey" not in read
