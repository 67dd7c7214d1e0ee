"""Single operators, each as a query with its SQL twin.

Every query here shows one operator of the engine's coverage list on the data at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions import day, strftime
from lakeweave.operators.joins import not_in, range_join
from lakeweave.plans import Registry
from lakeweave.sources.catalog import Tables

REL = Registry("rel_")


# scans, projection, filters


@REL("SELECT * FROM region")
def scan_region(t: Tables) -> DataFrame:
    return t.region


@REL("SELECT COUNT(*) AS x FROM (SELECT DISTINCT * FROM lineitem) AS s")
def count_distinct_rows(t: Tables) -> DataFrame:
    return t.lineitem.distinct().agg(F.count("*").alias("x"))


@REL("SELECT o_orderkey AS k, o_totalprice * 2 - 1 AS doubled, -o_custkey AS negated, o_totalprice + o_custkey AS added FROM orders AS o")
def project_arithmetic(t: Tables) -> DataFrame:
    o = t.orders.alias("o")
    return o.select(F.col("o.o_orderkey").alias("k"), (F.col("o_totalprice") * 2 - 1).alias("doubled"), (-F.col("o_custkey")).alias("negated"), (F.col("o_totalprice") + F.col("o_custkey")).alias("added"))


@REL("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity BETWEEN 10 AND 12 OR l_discount >= 0.09) AND l_returnflag <> 'N' AND NOT (l_linestatus = 'O' AND l_tax < 0.02)
 AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'""")
def filter_boolean(t: Tables) -> DataFrame:
    kept = (F.col("l_quantity").between(10, 12) | (F.col("l_discount") >= 0.09)) & (F.col("l_returnflag") != "N") & ~((F.col("l_linestatus") == "O") & (F.col("l_tax") < 0.02))
    return t.lineitem.where(kept & F.col("l_shipdate").between(day("1996-01-01"), day("1996-12-31"))).select("l_orderkey", "l_linenumber", "l_quantity")


@REL("SELECT p_partkey, p_name, p_type FROM part WHERE p_name LIKE 'cold%' OR p_name LIKE '%widget' OR (p_name LIKE '%e%r%' AND p_type NOT LIKE '%O%') OR p_brand BETWEEN 'Brand#20' AND 'Brand#21'")
def filter_like(t: Tables) -> DataFrame:
    name = F.col("p_name")
    kept = name.like("cold%") | name.like("%widget") | (name.like("%e%r%") & ~F.col("p_type").like("%O%")) | F.col("p_brand").between("Brand#20", "Brand#21")
    return t.part.where(kept).select("p_partkey", "p_name", "p_type")


@REL("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') AND c_nationkey IN (1, 2, 3) AND c_custkey NOT IN (5, 6)")
def filter_in(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "FURNITURE") & F.col("c_nationkey").isin(1, 2, 3) & ~F.col("c_custkey").isin(5, 6)).select("c_custkey")


@REL("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE WHEN o_orderstatus = 'F' THEN 1 END AS done FROM orders")
def case_when(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.when(price > 300000, "high").when(price > 100000, "mid").otherwise("low").alias("band"), F.when(F.col("o_orderstatus") == "F", 1).alias("done"))


@REL("SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS i, CAST(o_orderkey AS VARCHAR) AS s, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, CAST(o_orderkey AS DOUBLE) AS f, CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS DOUBLE) AS m FROM orders")
def cast_types(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.col("o_custkey").cast("int").alias("i"), F.col("o_orderkey").cast("string").alias("s"), F.col("o_orderdate").cast("date").cast("string").alias("d"), F.col("o_orderkey").cast("double").alias("f"), F.col("o_totalprice").cast("decimal(15,2)").cast("double").alias("m"))


@REL("SELECT c_custkey, o_orderkey IS NULL AS no_order, COALESCE(o_orderkey, -1) AS k, NULLIF(c_mktsegment, 'BUILDING') AS segment FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01'")
def null_functions(t: Tables) -> DataFrame:
    late = t.orders.where(F.col("o_orderdate") >= day("2001-01-01"))
    both = t.customer.join(late, F.col("o_custkey") == F.col("c_custkey"), "left")
    return both.select("c_custkey", F.col("o_orderkey").isNull().alias("no_order"), F.coalesce("o_orderkey", F.lit(-1)).alias("k"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))


# joins and subqueries


@REL("SELECT o_orderkey, c_name, n_name FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND o_totalprice > 300000")
def join_inner(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice > 300000").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@REL("SELECT s_suppkey, l_orderkey, l_linenumber FROM lineitem RIGHT JOIN supplier ON l_suppkey = s_suppkey AND l_quantity = 50 AND l_discount = 0.1")
def join_right(t: Tables) -> DataFrame:
    lines = t.lineitem.where((F.col("l_quantity") == 50) & (F.col("l_discount") == 0.1))
    return lines.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"), "right").select("s_suppkey", "l_orderkey", "l_linenumber")


@REL("SELECT a.n_name AS a, b.n_name AS b FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 10) b ON a.n_nationkey = b.n_nationkey")
def join_full(t: Tables) -> DataFrame:
    a, b = t.nation.where("n_nationkey < 15").alias("a"), t.nation.where("n_nationkey > 10").alias("b")
    return a.join(b, F.col("a.n_nationkey") == F.col("b.n_nationkey"), "full").select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@REL("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(t: Tables) -> DataFrame:
    return t.nation.crossJoin(t.region).select("n_name", "r_name")


@REL("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@REL("SELECT k, COUNT(*) AS n FROM (SELECT l_orderkey AS k, l_quantity FROM lineitem) JOIN (SELECT o_orderkey AS k, o_custkey FROM orders) USING (k) GROUP BY k HAVING COUNT(*) > 9")
def join_using(t: Tables) -> DataFrame:
    lines, orders = t.lineitem.select(F.col("l_orderkey").alias("k")), t.orders.select(F.col("o_orderkey").alias("k"))
    return lines.join(orders, "k").groupBy("k").agg(F.count("*").alias("n")).where("n > 9")


@REL("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50 AND l_shipdate <> o_orderdate)")
def semi_exists(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem.where("l_quantity = 50"), (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") != F.col("o_orderdate")), "left_semi").select("o_orderkey")


@REL("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_not_exists(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@REL("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 280))")
def semi_in_nested(t: Tables) -> DataFrame:
    large = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q")).where("q > 280")
    buyers = t.orders.join(large, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(buyers, "c_custkey", "left_semi").select("c_custkey")


@REL("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey > 1 THEN r_regionkey END FROM region WHERE r_regionkey > 1)")
def anti_not_in(t: Tables) -> DataFrame:
    return not_in(t.nation, "n_nationkey", t.region.where("r_regionkey > 1").select("r_regionkey")).select("n_nationkey")


@REL("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey > 1 THEN r_regionkey END FROM region)")
def anti_not_in_with_null(t: Tables) -> DataFrame:
    return not_in(t.nation, "n_nationkey", t.region.select(F.when(F.col("r_regionkey") > 1, F.col("r_regionkey")).alias("k"))).select("n_nationkey")


@REL("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.9 FROM orders)")
def scalar_subquery(t: Tables) -> DataFrame:
    bound = t.orders.agg((F.avg("o_totalprice") * 1.9).alias("bound"))  # one row
    return t.orders.join(F.broadcast(bound), F.col("o_totalprice") > F.col("bound")).select("o_orderkey")


@REL("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem a WHERE l_quantity > (SELECT 1.8 * AVG(l_quantity) FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_returnflag = a.l_returnflag)")
def scalar_subquery_correlated(t: Tables) -> DataFrame:
    keys = ["l_partkey", "l_returnflag"]
    usual = t.lineitem.groupBy(*keys).agg((1.8 * F.avg("l_quantity")).alias("bound"))
    return t.lineitem.join(usual, keys).where(F.col("l_quantity") > F.col("bound")).select("l_orderkey", "l_linenumber", "l_quantity")


@REL("SELECT c_custkey, o.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) o")
def lateral_top(t: Tables) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    top = t.orders.withColumn("rank", rank).where("rank <= 2")
    return t.customer.join(top, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@REL("WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey), named AS (SELECT c_name, n FROM big JOIN customer ON c_custkey = o_custkey) SELECT n, COUNT(*) AS customers, MIN(c_name) AS first FROM named GROUP BY n")
def cte_chain(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 200000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return big.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy("n").agg(F.count("*").alias("customers"), F.min("c_name").alias("first"))


@REL("SELECT e.event_id, r.lo FROM events e JOIN (SELECT CAST(value AS DOUBLE) AS lo, CAST(value + 0.5 AS DOUBLE) AS hi FROM (SELECT DISTINCT FLOOR(value) AS value FROM events)) r ON e.value >= r.lo AND e.value < r.hi")
def join_range(t: Tables) -> DataFrame:
    spans = t.events.select(F.floor("value").cast("double").alias("lo")).distinct().withColumn("hi", F.col("lo") + 0.5)
    return range_join(t.events, "value", spans, "lo", "hi", width=1.0).select("event_id", "lo")


# aggregation


@REL("""SELECT l_returnflag, CAST(SUM(l_linenumber) AS BIGINT) AS total, ROUND(AVG(l_quantity), 6) AS mean, MIN(l_extendedprice) AS low, MAX(l_extendedprice) AS high, COUNT(*) AS n, COUNT(l_partkey) AS parts, COUNT(DISTINCT l_partkey) AS distinct_parts,
 COUNT(CASE WHEN l_quantity > 25 THEN 1 END) AS many, COUNT(*) FILTER (WHERE l_discount > 0.05) AS cheap FROM lineitem GROUP BY l_returnflag""")
def aggregate_grouped(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        F.sum("l_linenumber").alias("total"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.count("*").alias("n"),
        F.count("l_partkey").alias("parts"), F.countDistinct("l_partkey").alias("distinct_parts"), F.count(F.when(F.col("l_quantity") > 25, 1)).alias("many"), F.count_if(F.col("l_discount") > 0.05).alias("cheap"),
    )


@REL("SELECT COUNT(*) AS n, MIN(o_orderdate) AS first, MAX(o_orderdate) AS last FROM orders WHERE o_totalprice < 0")
def aggregate_global_empty(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice < 0").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@REL("SELECT l_suppkey AS supplier_no, COUNT(*) AS n FROM lineitem GROUP BY supplier_no HAVING COUNT(*) > (SELECT COUNT(*) FROM lineitem) / (SELECT COUNT(DISTINCT l_suppkey) FROM lineitem)")
def having_over_subquery(t: Tables) -> DataFrame:
    mean = t.lineitem.agg((F.count("*") / F.countDistinct("l_suppkey")).alias("mean"))  # one row
    by = t.lineitem.groupBy(F.col("l_suppkey").alias("supplier_no")).agg(F.count("*").alias("n"))
    return by.join(F.broadcast(mean), F.col("n") > F.col("mean")).select("supplier_no", "n")


@REL("SELECT n, COUNT(*) AS orders FROM (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY n")
def aggregate_of_aggregate(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("orders"))


@REL("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@REL("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@REL("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(t: Tables) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return t.orders.groupingSets([[status], [priority], []], status, priority).agg(F.count("*").alias("n"))


@REL("SELECT c_mktsegment, ROUND(STDDEV(c_acctbal), 6) AS sd, ROUND(VAR_POP(c_acctbal), 4) AS vp, ROUND(QUANTILE_CONT(c_acctbal, 0.5), 6) AS med, ARG_MAX(c_custkey, c_acctbal) AS richest, STRING_AGG(DISTINCT CAST(c_nationkey AS VARCHAR), ',' ORDER BY CAST(c_nationkey AS VARCHAR)) AS nations FROM customer GROUP BY c_mktsegment")
def aggregate_statistics(t: Tables) -> DataFrame:
    balance = F.col("c_acctbal")
    nations = F.array_join(F.array_sort(F.collect_set(F.col("c_nationkey").cast("string"))), ",")
    return t.customer.groupBy("c_mktsegment").agg(F.round(F.stddev(balance), 6).alias("sd"), F.round(F.var_pop(balance), 4).alias("vp"), F.round(F.percentile(balance, F.lit(0.5)), 6).alias("med"), F.max_by("c_custkey", balance).alias("richest"), nations.alias("nations"))


# windows


@REL("""SELECT o_orderkey, CAST(ROW_NUMBER() OVER w AS INT) AS rn, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INT) AS rk, CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INT) AS dr, CAST(NTILE(4) OVER w AS INT) AS tile,
 ROUND(PERCENT_RANK() OVER w, 9) AS pr, ROUND(CUME_DIST() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)""")
def window_ranking(t: Tables) -> DataFrame:
    w, s = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    return t.orders.select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(s).alias("rk"), F.dense_rank().over(s).alias("dr"), F.ntile(4).over(w).alias("tile"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))


@REL("""SELECT event_id, LAG(event_type) OVER w AS before, LEAD(event_id, 2) OVER w AS after, FIRST_VALUE(event_id) OVER w AS first, NTH_VALUE(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second,
 LAST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_analytic(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.events.select("event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_id", 2).over(w).alias("after"), F.first("event_id").over(w).alias("first"), F.nth_value("event_id", 2).over(whole).alias("second"), F.last("event_id").over(whole).alias("last"))


@REL("""SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rows3, COUNT(*) OVER (PARTITION BY user_id) AS n,
 COUNT(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS last_hour FROM events""")
def window_frames(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    return t.events.select("event_id", F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 6).alias("rows3"), F.count("*").over(Window.partitionBy("user_id")).alias("n"), F.count("*").over(Window.partitionBy("user_id").orderBy(second).rangeBetween(-3600, 0)).alias("last_hour"))


@REL("SELECT o_custkey, o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def window_qualify(t: Tables) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t.orders.withColumn("rank", rank).where("rank = 1").select("o_custkey", "o_orderkey")


# order, limits, sets


@REL("SELECT s_name, s_acctbal, s_suppkey FROM supplier ORDER BY 2 DESC, 1 LIMIT 10")
def top_k(t: Tables) -> DataFrame:
    return t.supplier.select("s_name", "s_acctbal", "s_suppkey").orderBy(F.desc("s_acctbal"), "s_name").limit(10)


@REL("SELECT k, o_orderkey FROM (SELECT CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS k, o_orderkey FROM orders) ORDER BY k ASC NULLS FIRST, o_orderkey DESC LIMIT 7000 OFFSET 4000")
def order_nulls_offset(t: Tables) -> DataFrame:
    return t.orders.select(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("k"), "o_orderkey").orderBy(F.asc_nulls_first("k"), F.desc("o_orderkey")).offset(4000).limit(7000)


@REL("SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def union_all(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("k")).unionByName(t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("k")))


@REL("SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def union_distinct(t: Tables) -> DataFrame:
    return union_all(t).distinct()


def _two(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))


_SETS = "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' {} SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'"


@REL(_SETS.format("INTERSECT"))
def intersect(t: Tables) -> DataFrame:
    a, b = _two(t)
    return a.intersect(b)


@REL(_SETS.format("INTERSECT ALL"))
def intersect_all(t: Tables) -> DataFrame:
    a, b = _two(t)
    return a.intersectAll(b)


@REL(_SETS.format("EXCEPT"))
def except_distinct(t: Tables) -> DataFrame:
    a, b = _two(t)
    return a.subtract(b)


@REL(_SETS.format("EXCEPT ALL"))
def except_all(t: Tables) -> DataFrame:
    a, b = _two(t)
    return a.exceptAll(b)


# scalar functions


@REL("SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%Y-%m-%d') AS ymd, CAST(extract(quarter FROM o_orderdate) AS INT) AS q, CAST(CAST(o_orderdate AS DATE) - 90 AS VARCHAR) AS earlier, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS mon, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days FROM orders")
def functions_date(t: Tables) -> DataFrame:
    at = F.col("o_orderdate")
    return t.orders.select("o_orderkey", strftime(at, "%Y").alias("y"), strftime(at, "%Y-%m-%d").alias("ymd"), F.quarter(at).alias("q"), F.date_sub(at.cast("date"), 90).cast("string").alias("earlier"), strftime(F.date_trunc("month", at), "%Y-%m-%d").alias("mon"), F.datediff(at.cast("date"), F.lit("1995-01-01").cast("date")).alias("days"))


@REL("SELECT c_custkey, substr(c_name, 1, 4) AS head, upper(c_name) AS up, CAST(length(c_name) AS INT) AS n, replace(c_name, '#', '-') AS rep, lower(c_mktsegment) || '/' || c_name AS both, CAST(strpos(c_name, '#') AS INT) AS at, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS padded, reverse(c_mktsegment) AS rev FROM customer")
def functions_string(t: Tables) -> DataFrame:
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return t.customer.select("c_custkey", F.substring(name, 1, 4).alias("head"), F.upper(name).alias("up"), F.length(name).alias("n"), F.replace(name, F.lit("#"), F.lit("-")).alias("rep"), F.concat(F.lower(segment), F.lit("/"), name).alias("both"), F.instr(name, "#").alias("at"), F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("padded"), F.reverse(segment).alias("rev"))


@REL("SELECT s_suppkey, abs(s_acctbal) AS a, s_suppkey % 7 AS m, round(s_acctbal, 1) AS r, CAST(floor(s_acctbal) AS BIGINT) AS f, CAST(ceil(s_acctbal) AS BIGINT) AS c, round(sqrt(abs(s_acctbal)), 9) AS s, round(power(s_suppkey, 2), 3) AS p, CAST(sign(s_acctbal) AS INT) AS g, greatest(s_suppkey, 50) AS top FROM supplier")
def functions_math(t: Tables) -> DataFrame:
    b, k = F.col("s_acctbal"), F.col("s_suppkey")
    return t.supplier.select("s_suppkey", F.abs(b).alias("a"), (k % 7).alias("m"), F.round(b, 1).alias("r"), F.floor(b).cast("bigint").alias("f"), F.ceil(b).cast("bigint").alias("c"), F.round(F.sqrt(F.abs(b)), 9).alias("s"), F.round(F.pow(k, F.lit(2)), 3).alias("p"), F.signum(b).cast("int").alias("g"), F.greatest(k, F.lit(50)).alias("top"))


@REL("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def functions_json(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@REL("SELECT vec_id, CAST(len(embedding) AS INT) AS n, CAST(embedding[1] AS DOUBLE) AS head, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS norm, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS positive FROM embeddings")
def functions_array(t: Tables) -> DataFrame:
    e = F.col("embedding")
    square = F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return t.embeddings.select("vec_id", F.size(e).alias("n"), F.element_at(e, 1).cast("double").alias("head"), F.round(square, 4).alias("norm"), F.size(F.filter(e, lambda x: x > 0)).alias("positive"))


@REL("SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, COUNT(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low FROM orders GROUP BY o_orderstatus")
def pivot_counts(t: Tables) -> DataFrame:
    wanted = t.orders.groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count(F.lit(1)))
    return wanted.select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low"))


@REL("SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)")
def join_natural(t: Tables) -> DataFrame:
    a, b = t.nation.select(F.col("n_regionkey").alias("k"), "n_name"), t.region.select(F.col("r_regionkey").alias("k"), "r_name")
    return a.join(b, [c for c in a.columns if c in b.columns])


@REL("SELECT c_nationkey, MAP_FROM_ENTRIES(LIST((c_mktsegment, n) ORDER BY c_mktsegment))['BUILDING'] AS building, STRUCT_EXTRACT({'lo': MIN(n), 'hi': MAX(n)}, 'hi') AS most FROM (SELECT c_nationkey, c_mktsegment, COUNT(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey")
def functions_map_struct(t: Tables) -> DataFrame:
    each = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    told = each.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n"))).alias("m"), F.struct(F.min("n").alias("lo"), F.max("n").alias("hi")).alias("s"))
    return told.select("c_nationkey", F.try_element_at("m", F.lit("BUILDING")).alias("building"), F.col("s.hi").alias("most"))


@REL("SELECT l_returnflag, ABS(APPROX_COUNT_DISTINCT(l_orderkey) - COUNT(DISTINCT l_orderkey)) <= 0.25 * COUNT(DISTINCT l_orderkey) AS near_distinct, ABS(APPROX_QUANTILE(l_quantity, 0.5) - MEDIAN(l_quantity)) <= 2 AS near_median FROM lineitem GROUP BY l_returnflag")
def aggregate_approximate(t: Tables) -> DataFrame:
    # sketches beside an exact distinct count would be kept for each distinct key, so keys are counted on their own
    gap = F.abs(F.percentile_approx("l_quantity", 0.5) - F.median("l_quantity"))
    sketched = t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey").alias("about"), (gap <= 2).alias("near_median"))
    keys = t.lineitem.select(F.col("l_returnflag").alias("flag"), "l_orderkey").distinct().groupBy("flag").agg(F.count("l_orderkey").alias("n"))
    both = sketched.join(keys, F.col("l_returnflag").eqNullSafe(F.col("flag")))
    return both.select("l_returnflag", (F.abs(F.col("about") - F.col("n")) <= 0.25 * F.col("n")).alias("near_distinct"), "near_median")


@REL("SELECT COUNT(*) AS n FROM (SELECT o_orderkey FROM orders LIMIT 77)")
def limit_without_order(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").limit(77).agg(F.count("*").alias("n"))


@REL("SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def set_operation_in_subquery(t: Tables) -> DataFrame:
    rich = t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey")).subtract(t.supplier.where("s_acctbal > 5000").select("s_nationkey"))
    return t.nation.join(rich, "n_nationkey", "left_semi").select("n_name")
