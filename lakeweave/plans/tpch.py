"""The TPC-H family over the star-schema tables at hand.

The tables lack some columns of the benchmark. Stand-ins: `partsupp` is derived from
lineitem (one row for each part and supplier), a line is late if it ships over 60 days
after its order, line status and return flag stand for shipping mode and instructions,
part type for container. Dimension tables are joined without hints: whether a side is
small enough to be broadcast is for Spark to see from its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.functions import day, strftime
from lakeweave.plans import Registry
from lakeweave.sources.catalog import Tables

TPCH = Registry("tpch_")

PARTSUPP = "ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(SUM(l_quantity) AS BIGINT) AS ps_availqty, MIN(l_extendedprice) AS ps_supplycost FROM lineitem GROUP BY ALL)"


def partsupp(lines: DataFrame) -> DataFrame:
    """The stand-in from lines, which may be narrowed to some parts or suppliers beforehand: those are its keys."""
    return lines.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(F.sum("l_quantity").cast("bigint").alias("ps_availqty"), F.min("l_extendedprice").alias("ps_supplycost"))


def net() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def money(total: Column, name: str) -> Column:
    """A sum of money to the cent: sums of doubles depend on their order in the last digits."""
    return F.round(total, 2).cast("double").alias(name)


def late() -> Column:
    return F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")


def within(column: str, first: str, end: str) -> Column:
    return (F.col(column) >= day(first)) & (F.col(column) < day(end))


def placed(t: Tables, side: str, region: str | None = None) -> DataFrame:
    """Customers or suppliers (side c or s) with their nation's name, of one region if named."""
    people = t.customer if side == "c" else t.supplier
    nation = t.nation
    if region:
        nation = nation.join(t.region.where(F.col("r_name") == region), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return people.join(nation.select(F.col("n_nationkey").alias(f"{side}_nationkey"), F.col("n_name").alias(f"{side}_nation")), f"{side}_nationkey")


@TPCH("""
SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base_price,
 ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
 ROUND(AVG(l_quantity), 6) AS avg_qty, ROUND(AVG(l_extendedprice), 6) AS avg_price, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL ORDER BY ALL""")
def h01(t: Tables) -> DataFrame:
    return (
        t.lineitem.where(F.col("l_shipdate") <= day("1998-09-02"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            money(F.sum("l_quantity"), "sum_qty"),
            money(F.sum("l_extendedprice"), "sum_base_price"),
            money(F.sum(net()), "sum_disc_price"),
            money(F.sum(net() * (1 + F.col("l_tax"))), "sum_charge"),
            *[F.round(F.avg(c), 6).alias(n) for c, n in (("l_quantity", "avg_qty"), ("l_extendedprice", "avg_price"), ("l_discount", "avg_disc"))],
            F.count("*").alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


@TPCH(f"""
WITH {PARTSUPP}, offer AS (SELECT ps.*, s_acctbal, s_name, n_name FROM ps JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey AND r_name = 'EUROPE')
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM part JOIN offer o ON o.ps_partkey = p_partkey
WHERE p_size = 25 AND p_type LIKE '%ARD' AND o.ps_supplycost = (SELECT MIN(x.ps_supplycost) FROM offer x WHERE x.ps_partkey = p_partkey)
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""")
def h02(t: Tables) -> DataFrame:
    parts = t.part.where((F.col("p_size") == 25) & F.col("p_type").like("%ARD")).select("p_partkey", "p_brand")
    wanted = t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    offers = partsupp(wanted).join(placed(t, "s", "EUROPE"), F.col("ps_suppkey") == F.col("s_suppkey")).join(parts, F.col("ps_partkey") == F.col("p_partkey"))
    least = offers.groupBy("p_partkey").agg(F.min("ps_supplycost").alias("least"))
    best = offers.join(least, "p_partkey").where(F.col("ps_supplycost") == F.col("least"))
    return best.select("s_acctbal", "s_name", F.col("s_nation").alias("n_name"), "p_partkey", "p_brand").orderBy(F.desc("s_acctbal"), "n_name", "s_name", "p_partkey").limit(100)


@TPCH("""
SELECT l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
def h03(t: Tables) -> DataFrame:
    buyers = t.customer.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    open_orders = t.orders.where(F.col("o_orderdate") < day("1998-03-15")).join(buyers, "o_custkey", "left_semi")
    lines = t.lineitem.where(F.col("l_shipdate") > day("1998-03-15")).join(open_orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("l_orderkey", "o_orderdate").agg(money(F.sum(net()), "revenue")).orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10)


@TPCH("""
SELECT o_orderpriority, COUNT(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1996-07-01' AND o_orderdate < TIMESTAMP '1996-10-01'
 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAYS) GROUP BY o_orderpriority ORDER BY o_orderpriority""")
def h04(t: Tables) -> DataFrame:
    quarter = t.orders.where(within("o_orderdate", "1996-07-01", "1996-10-01"))
    tardy = quarter.join(t.lineitem, (F.col("l_orderkey") == F.col("o_orderkey")) & late(), "left_semi")
    return tardy.groupBy("o_orderpriority").agg(F.count("*").alias("order_count")).orderBy("o_orderpriority")


@TPCH("""
SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey
 JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey AND c_nationkey = s_nationkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name ORDER BY revenue DESC""")
def h05(t: Tables) -> DataFrame:
    sellers = placed(t, "s", "ASIA").select("s_suppkey", "s_nationkey", F.col("s_nation").alias("n_name"))
    year = t.orders.where(within("o_orderdate", "1996-01-01", "1997-01-01")).select("o_orderkey", "o_custkey")
    lines = t.lineitem.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(year, F.col("l_orderkey") == F.col("o_orderkey"))
    at_home = lines.join(t.customer, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")), "left_semi")
    return at_home.groupBy("n_name").agg(money(F.sum(net()), "revenue")).orderBy(F.desc("revenue"))


@TPCH("""
SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def h06(t: Tables) -> DataFrame:
    some = t.lineitem.where(within("l_shipdate", "1996-01-01", "1997-01-01") & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return some.agg(money(F.sum(F.col("l_extendedprice") * F.col("l_discount")), "revenue"))


@TPCH("""
SELECT supp_nation, cust_nation, l_year, ROUND(SUM(volume), 2) AS revenue FROM (
 SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, strftime(l_shipdate, '%Y') AS l_year, l_extendedprice * (1 - l_discount) AS volume
 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey
 WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' AND (a.n_name, b.n_name) IN (('NATION_3', 'NATION_7'), ('NATION_7', 'NATION_3'))) GROUP BY ALL ORDER BY ALL""")
def h07(t: Tables) -> DataFrame:
    pair = ("NATION_3", "NATION_7")
    sellers = placed(t, "s").where(F.col("s_nation").isin(*pair)).select("s_suppkey", F.col("s_nation").alias("supp_nation"))
    buyers = placed(t, "c").where(F.col("c_nation").isin(*pair)).select("c_custkey", F.col("c_nation").alias("cust_nation"))
    lines = t.lineitem.where(F.col("l_shipdate").between(day("1996-01-01"), day("1997-12-31")))
    trade = lines.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    trade = trade.join(buyers, F.col("o_custkey") == F.col("c_custkey")).where(F.col("supp_nation") != F.col("cust_nation"))
    keys = ["supp_nation", "cust_nation", "l_year"]
    return trade.withColumn("l_year", strftime(F.col("l_shipdate"), "%Y")).groupBy(*keys).agg(money(F.sum(net()), "revenue")).orderBy(*keys)


@TPCH("""
SELECT strftime(o_orderdate, '%Y') AS o_year, ROUND(SUM(CASE WHEN n2.n_name = 'NATION_3' THEN l_extendedprice * (1 - l_discount) ELSE 0 END), 2) AS numerator, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS mkt_share
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation n2 ON n2.n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
 JOIN nation n1 ON n1.n_nationkey = c_nationkey JOIN region ON r_regionkey = n1.n_regionkey
WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' GROUP BY 1 ORDER BY 1""")
def h08(t: Tables) -> DataFrame:
    parts = t.part.where(F.col("p_type") == "ECONOMY").select(F.col("p_partkey").alias("l_partkey"))
    years = t.orders.where(F.col("o_orderdate").between(day("1996-01-01"), day("1997-12-31")))
    buyers = placed(t, "c", "AMERICA").select(F.col("c_custkey").alias("o_custkey"))
    sold = t.lineitem.join(parts, "l_partkey", "left_semi").join(years.join(buyers, "o_custkey", "left_semi"), F.col("l_orderkey") == F.col("o_orderkey"))
    sold = sold.join(placed(t, "s").select("s_suppkey", "s_nation"), F.col("l_suppkey") == F.col("s_suppkey"))
    own = F.when(F.col("s_nation") == "NATION_3", net()).otherwise(0)
    return sold.groupBy(strftime(F.col("o_orderdate"), "%Y").alias("o_year")).agg(money(F.sum(own), "numerator"), money(F.sum(net()), "mkt_share")).orderBy("o_year")


@TPCH(f"""
WITH {PARTSUPP} SELECT n_name AS nation, strftime(o_orderdate, '%Y') AS o_year, ROUND(SUM(l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity), 2) AS sum_profit
FROM lineitem JOIN ps ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey
WHERE p_name LIKE '%gear%' GROUP BY ALL ORDER BY nation, o_year DESC""")
def h09(t: Tables) -> DataFrame:
    gears = t.part.where(F.col("p_name").like("%gear%")).select(F.col("p_partkey").alias("l_partkey"))
    lines = t.lineitem.join(gears, "l_partkey", "left_semi")
    lines = lines.join(partsupp(lines), (F.col("ps_partkey") == F.col("l_partkey")) & (F.col("ps_suppkey") == F.col("l_suppkey")))
    lines = lines.join(placed(t, "s").select("s_suppkey", F.col("s_nation").alias("nation")), F.col("l_suppkey") == F.col("s_suppkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    profit = net() - F.col("ps_supplycost") * F.col("l_quantity")
    return lines.groupBy("nation", strftime(F.col("o_orderdate"), "%Y").alias("o_year")).agg(money(F.sum(profit), "sum_profit")).orderBy("nation", F.desc("o_year"))


@TPCH("""
SELECT c_custkey, c_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY ALL ORDER BY revenue DESC, c_custkey LIMIT 20""")
def h10(t: Tables) -> DataFrame:
    returned = t.lineitem.where(F.col("l_returnflag") == "R").join(t.orders.where(within("o_orderdate", "1996-10-01", "1997-01-01")), F.col("l_orderkey") == F.col("o_orderkey"))
    # revenue by customer first: names are joined to one row for each customer
    by_customer = returned.groupBy(F.col("o_custkey").alias("c_custkey")).agg(money(F.sum(net()), "revenue"))
    return by_customer.join(placed(t, "c"), "c_custkey").select("c_custkey", "c_name", "revenue", "c_acctbal", F.col("c_nation").alias("n_name")).orderBy(F.desc("revenue"), "c_custkey").limit(20)


@TPCH(f"""
WITH {PARTSUPP}, held AS (SELECT ps_partkey, ps_supplycost * ps_availqty AS v FROM ps JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_3')
SELECT ps_partkey, ROUND(SUM(v), 2) AS value FROM held GROUP BY ps_partkey HAVING SUM(v) > (SELECT SUM(v) * 0.001 FROM held) ORDER BY value DESC, ps_partkey""")
def h11(t: Tables) -> DataFrame:
    sellers = placed(t, "s").where(F.col("s_nation") == "NATION_3").select(F.col("s_suppkey").alias("l_suppkey"))
    held = partsupp(t.lineitem.join(sellers, "l_suppkey", "left_semi")).select("ps_partkey", (F.col("ps_supplycost") * F.col("ps_availqty")).alias("v"))
    floor = held.agg((F.sum("v") * 0.001).alias("floor"))  # one row
    totals = held.groupBy("ps_partkey").agg(F.sum("v").alias("total"))
    return totals.join(F.broadcast(floor), F.col("total") > F.col("floor")).select("ps_partkey", money(F.col("total"), "value")).orderBy(F.desc("value"), "ps_partkey")


@TPCH("""
SELECT l_linestatus, CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count, CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END) AS BIGINT) AS low_line_count
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') AND l_shipdate > o_orderdate + INTERVAL 60 DAYS AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY l_linestatus ORDER BY l_linestatus""")
def h12(t: Tables) -> DataFrame:
    lines = t.lineitem.where(F.col("l_returnflag").isin("A", "R") & within("l_shipdate", "1996-01-01", "1997-01-01"))
    tardy = lines.join(t.orders, (F.col("o_orderkey") == F.col("l_orderkey")) & late())
    high = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return tardy.groupBy("l_linestatus").agg(F.count_if(high).alias("high_line_count"), F.count_if(~high).alias("low_line_count")).orderBy("l_linestatus")


@TPCH("""
SELECT c_count, COUNT(*) AS custdist FROM (SELECT c_custkey, COUNT(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority NOT LIKE '%URGENT%' AND o_orderdate >= TIMESTAMP '2000-06-01' GROUP BY c_custkey)
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""")
def h13(t: Tables) -> DataFrame:
    counted = t.orders.where(~F.col("o_orderpriority").like("%URGENT%") & (F.col("o_orderdate") >= day("2000-06-01")))
    each = t.customer.join(counted, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("c_count"))
    return each.groupBy("c_count").agg(F.count("*").alias("custdist")).orderBy(F.desc("custdist"), F.desc("c_count"))


@TPCH("""
SELECT ROUND(SUM(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END), 2) AS x, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS promo_revenue
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '1996-09-01' AND l_shipdate < TIMESTAMP '1996-10-01'""")
def h14(t: Tables) -> DataFrame:
    month = t.lineitem.where(within("l_shipdate", "1996-09-01", "1996-10-01")).join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return month.agg(money(F.sum(F.when(F.col("p_type").like("PROMO%"), net()).otherwise(0)), "x"), money(F.sum(net()), "promo_revenue"))


@TPCH("""
WITH r AS (SELECT l_suppkey AS k, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN r ON k = s_suppkey WHERE total_revenue = (SELECT MAX(total_revenue) FROM r) ORDER BY s_suppkey""")
def h15(t: Tables) -> DataFrame:
    quarter = t.lineitem.where(within("l_shipdate", "1996-01-01", "1996-04-01"))
    revenue = quarter.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(money(F.sum(net()), "total_revenue"))
    top = revenue.agg(F.max("total_revenue").alias("total_revenue"))  # one row
    return revenue.join(F.broadcast(top), "total_revenue", "left_semi").join(t.supplier, "s_suppkey").select("s_suppkey", "s_name", "total_revenue").orderBy("s_suppkey")


@TPCH(f"""
WITH {PARTSUPP} SELECT p_brand, p_type, p_size, COUNT(DISTINCT ps_suppkey) AS supplier_cnt FROM ps JOIN part ON p_partkey = ps_partkey
WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY ALL ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""")
def h16(t: Tables) -> DataFrame:
    parts = t.part.where((F.col("p_brand") != "Brand#5") & ~F.col("p_type").like("MEDIUM%") & F.col("p_size").isin(3, 9, 14, 19, 23, 36, 45, 49))
    # s_suppkey is a key without nulls, so NOT IN is a plain anti join
    barred = t.supplier.where((F.col("s_acctbal") < 0) & F.col("s_suppkey").isNotNull()).select(F.col("s_suppkey").alias("ps_suppkey"))
    wanted = t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    left = partsupp(wanted).select("ps_partkey", "ps_suppkey").join(barred, "ps_suppkey", "left_anti").join(parts, F.col("ps_partkey") == F.col("p_partkey"))
    return left.groupBy("p_brand", "p_type", "p_size").agg(F.countDistinct("ps_suppkey").alias("supplier_cnt")).orderBy(F.desc("supplier_cnt"), "p_brand", "p_type", "p_size")


@TPCH("""
SELECT ROUND(SUM(l_extendedprice), 2) AS avg_yearly FROM lineitem l JOIN part ON p_partkey = l.l_partkey WHERE p_brand = 'Brand#23' AND p_type = 'MEDIUM' AND l.l_quantity < (SELECT 0.2 * AVG(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)""")
def h17(t: Tables) -> DataFrame:
    parts = t.part.where((F.col("p_brand") == "Brand#23") & (F.col("p_type") == "MEDIUM")).select(F.col("p_partkey").alias("l_partkey"))
    lines = t.lineitem.select("l_partkey", "l_quantity", "l_extendedprice").join(parts, "l_partkey", "left_semi")
    usual = lines.groupBy("l_partkey").agg((0.2 * F.avg("l_quantity")).alias("low"))
    return lines.join(usual, "l_partkey").where(F.col("l_quantity") < F.col("low")).agg(money(F.sum("l_extendedprice"), "avg_yearly"))


@TPCH("""
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, ROUND(SUM(l_quantity), 2) AS sum_qty FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY ALL HAVING SUM(l_quantity) > 300 ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""")
def h18(t: Tables) -> DataFrame:
    # lines are summed to orders once: the large orders found this way are also the result's groups
    large = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q")).where("q > 300")
    named = large.join(t.orders, "o_orderkey").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return named.select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", money(F.col("q"), "sum_qty")).orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(100)


@TPCH("""
SELECT ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5) OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10) OR (p_brand = 'Brand#21' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)""")
def h19(t: Tables) -> DataFrame:
    wanted = F.lit(False)
    for brand, low, size in (("Brand#12", 1, 5), ("Brand#23", 10, 10), ("Brand#21", 20, 15)):
        wanted = wanted | ((F.col("p_brand") == brand) & F.col("l_quantity").between(low, low + 10) & F.col("p_size").between(1, size))
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).where(wanted).agg(money(F.sum(net()), "revenue"))


@TPCH(f"""
WITH {PARTSUPP} SELECT s_name, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_9' AND s_suppkey IN (SELECT ps_suppkey FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'cold%')
 AND ps_availqty > (SELECT 0.5 * SUM(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01')) ORDER BY s_name""")
def h20(t: Tables) -> DataFrame:
    cold = t.part.where(F.col("p_name").like("cold%")).select(F.col("p_partkey").alias("l_partkey"))
    lines = t.lineitem.select("l_partkey", "l_suppkey", "l_quantity", "l_shipdate").join(cold, "l_partkey", "left_semi")
    # stock and the year's use come from the same lines: one aggregation serves both
    use = lines.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").cast("bigint").alias("stock"), F.sum(F.when(within("l_shipdate", "1996-01-01", "1997-01-01"), F.col("l_quantity"))).alias("used"))
    ample = use.where(F.col("stock") > 0.5 * F.col("used")).select(F.col("l_suppkey").alias("s_suppkey"))
    return placed(t, "s").where(F.col("s_nation") == "NATION_9").join(ample, "s_suppkey", "left_semi").select("s_name", "s_acctbal").orderBy("s_name")


@TPCH("""
WITH x AS (SELECT l_orderkey, l_suppkey, l_shipdate > o_orderdate + INTERVAL 60 DAYS AS is_late FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F')
SELECT s_name, COUNT(*) AS numwait FROM x a JOIN supplier ON s_suppkey = a.l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_3' AND a.is_late
 AND EXISTS (SELECT 1 FROM x b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey) AND NOT EXISTS (SELECT 1 FROM x c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.is_late)
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""")
def h21(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_shipdate").join(t.orders.where(F.col("o_orderstatus") == "F"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_suppkey", late().alias("is_late"))
    # an order counts where several suppliers took part and just one was late: three figures of each order
    orders = lines.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b"), F.min(F.when(F.col("is_late"), F.col("l_suppkey"))).alias("first_late"), F.max(F.when(F.col("is_late"), F.col("l_suppkey"))).alias("last_late"), F.count_if("is_late").alias("n"))
    alone = orders.where("a <> b AND first_late = last_late").select(F.col("first_late").alias("s_suppkey"), "n")
    return alone.join(placed(t, "s").where(F.col("s_nation") == "NATION_3"), "s_suppkey").groupBy("s_name").agg(F.sum("n").alias("numwait")).orderBy(F.desc("numwait"), "s_name").limit(100)


@TPCH("""
WITH c AS (SELECT substr(c_name, 18, 1) AS cntrycode, c_acctbal, c_custkey FROM customer WHERE substr(c_name, 18, 1) IN ('1', '3', '7'))
SELECT cntrycode, COUNT(*) AS numcust, ROUND(SUM(c_acctbal), 2) AS totacctbal FROM c WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM c WHERE c_acctbal > 0)
 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-06-01') GROUP BY cntrycode ORDER BY cntrycode""")
def h22(t: Tables) -> DataFrame:
    some = t.customer.withColumn("cntrycode", F.substring("c_name", 18, 1)).where(F.col("cntrycode").isin("1", "3", "7"))
    mean = some.where("c_acctbal > 0").agg(F.avg("c_acctbal").alias("mean"))  # one row
    recent = t.orders.where(F.col("o_orderdate") >= day("2000-06-01")).select(F.col("o_custkey").alias("c_custkey"))
    idle = some.join(F.broadcast(mean), F.col("c_acctbal") > F.col("mean")).join(recent, "c_custkey", "left_anti")
    return idle.groupBy("cntrycode").agg(F.count("*").alias("numcust"), money(F.sum("c_acctbal"), "totacctbal")).orderBy("cntrycode")


@TPCH("""
SELECT n_name, p_type, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) AS count_star FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
 JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE r_name = 'ASIA' AND p_type = 'ECONOMY' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY ALL ORDER BY revenue DESC""")
def star01(t: Tables) -> DataFrame:
    sellers = placed(t, "s", "ASIA").select("s_suppkey", F.col("s_nation").alias("n_name"))
    year = t.orders.where(within("o_orderdate", "1996-01-01", "1997-01-01")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")
    parts = t.part.where(F.col("p_type") == "ECONOMY").select("p_partkey", "p_type")
    star = t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(year, F.col("l_orderkey") == F.col("o_orderkey"))
    return star.groupBy("n_name", "p_type").agg(money(F.sum(net()), "revenue"), F.count("*").alias("count_star")).orderBy(F.desc("revenue"))
