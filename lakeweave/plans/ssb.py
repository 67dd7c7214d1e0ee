"""The star-schema benchmark over views of the tables at hand.

`lineorder` is a line with its order; what `date_dim` says of an order's date is worked out from that date;
city, nation, region, category and manufacturer are derived from what the tables have.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.functions import day, strftime
from lakeweave.plans import Registry
from lakeweave.plans.tpch import money
from lakeweave.sources.catalog import Tables

SSB = Registry(
    "ssb_",
    """WITH lineorder AS (SELECT l_orderkey AS lo_orderkey, o_custkey AS lo_custkey, l_partkey AS lo_partkey, l_suppkey AS lo_suppkey, l_quantity AS lo_quantity, l_extendedprice AS lo_extendedprice,
 CAST(ROUND(l_discount * 100) AS INT) AS lo_discount, CAST(l_extendedprice AS DECIMAL(15, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))) AS lo_revenue, 0.6 * CAST(l_extendedprice AS DECIMAL(15, 2)) AS lo_supplycost, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS lo_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
date_dim AS (SELECT DISTINCT CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS d_datekey, CAST(year(o_orderdate) AS INT) AS d_year, CAST(strftime(o_orderdate, '%Y%m') AS INT) AS d_yearmonthnum, strftime(o_orderdate, '%b%Y') AS d_yearmonth, CAST(weekofyear(o_orderdate) AS INT) AS d_weeknuminyear FROM orders),
cust AS (SELECT c_custkey, n_name || '_' || CAST(c_custkey % 2 AS VARCHAR) AS c_city, n_name AS c_nation, r_name AS c_region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
supp AS (SELECT s_suppkey, n_name || '_' || CAST(s_suppkey % 2 AS VARCHAR) AS s_city, n_name AS s_nation, r_name AS s_region FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
prod AS (SELECT p_partkey, p_brand, p_type AS p_category, 'MFGR#' || CAST(CAST(substr(p_brand, 7) AS INT) % 5 + 1 AS VARCHAR) AS p_mfgr FROM part)
""",
)


#: Lines that a task groups by order, about: its memory stays the same whatever the size of the table.
LINES_OF_A_TASK = 400_000


class Star:
    """The fact with the dimensions asked for, each filtered before it is joined.

    A fact row is a line of an order. Dates and customers belong to the order, suppliers
    and parts to the line, so each side is narrowed by its own dimensions before the two
    large tables meet. The columns of a date depend on nothing but the date, so they need
    no join, and a range of years reaches the scan.
    """

    def __init__(self, t: Tables, lines: Column | None = None):
        self.t, self.of_lines = t, lines

    @property
    def orders(self) -> DataFrame:
        at = F.col("o_orderdate")
        return self.t.orders.select(
            "o_orderdate", F.col("o_orderkey").alias("lo_orderkey"), F.col("o_custkey").alias("lo_custkey"), _datekey().alias("lo_orderdate"),
            F.year(at).alias("d_year"), (F.year(at) * 100 + F.month(at)).alias("d_yearmonthnum"), strftime(at, "%b%Y").alias("d_yearmonth"), F.weekofyear(at).alias("d_weeknuminyear"),
        )

    @property
    def lines(self) -> DataFrame:
        price, discount = F.col("l_extendedprice"), F.col("l_discount")
        cents = price.cast("decimal(15,2)")  # sums that end in half a cent must not depend on the order of rows
        rows = self.t.lineitem if self.of_lines is None else self.t.lineitem.where(self.of_lines)
        return rows.select(
            F.col("l_orderkey").alias("lo_orderkey"), F.col("l_partkey").alias("lo_partkey"), F.col("l_suppkey").alias("lo_suppkey"), F.col("l_quantity").alias("lo_quantity"), price.alias("lo_extendedprice"),
            F.round(discount * 100).cast("int").alias("lo_discount"), (cents * (1 - discount.cast("decimal(4,2)"))).alias("lo_revenue"), (cents * F.lit(Decimal("0.6"))).alias("lo_supplycost"),
        )

    def people(self, side: str) -> DataFrame:
        table, key = (self.t.customer, "c_custkey") if side == "c" else (self.t.supplier, "s_suppkey")
        land = self.t.nation.join(self.t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        return table.join(land, F.col(f"{side}_nationkey") == F.col("n_nationkey")).select(key, F.concat_ws("_", "n_name", (F.col(key) % 2).cast("string")).alias(f"{side}_city"), F.col("n_name").alias(f"{side}_nation"), F.col("r_name").alias(f"{side}_region"))

    @property
    def parts(self) -> DataFrame:
        number = F.substring("p_brand", 7, 10).cast("int")
        return self.t.part.select("p_partkey", "p_brand", F.col("p_type").alias("p_category"), F.concat(F.lit("MFGR#"), (number % 5 + 1).cast("string")).alias("p_mfgr"))

    def join(self, dates: Column | None = None, years: tuple[int, int] | None = None, c: Column | None = None, s: Column | None = None, p: Column | None = None, deal: int | None = None) -> DataFrame:
        """The fact with the dimensions that have a condition, of the years from..to; by order in so many partitions if deal is given."""
        orders, lines = self.orders, self.lines
        if years is not None:
            orders = orders.where((F.col("o_orderdate") >= day(f"{years[0]}-01-01")) & (F.col("o_orderdate") < day(f"{years[1] + 1}-01-01")))
        if dates is not None:
            orders = orders.where(dates)
        if c is not None:
            orders = orders.join(self.people("c").where(c), F.col("lo_custkey") == F.col("c_custkey"))
        if s is not None:
            lines = lines.join(self.people("s").where(s), F.col("lo_suppkey") == F.col("s_suppkey"))
        if p is not None:
            lines = lines.join(self.parts.where(p), F.col("lo_partkey") == F.col("p_partkey"))
        if deal is not None:
            lines = lines.repartition(deal, "lo_orderkey")
        return lines.join(orders, "lo_orderkey")


def _datekey() -> Column:
    at = F.col("o_orderdate")
    return F.year(at) * 10000 + F.month(at) * 100 + F.dayofmonth(at)


def _is(column: str, *values: str | int) -> Column:
    return F.col(column).isin(*values)


def _any(column: str) -> Column:
    return F.col(column).isNotNull()


def _discounted(t: Tables, year: int, dates: Column | None, discount: tuple[int, int], quantity: Column) -> DataFrame:
    # hundredths decide; the wider range of l_discount reaches the scan
    near = F.col("l_discount").between(discount[0] / 100 - 0.006, discount[1] / 100 + 0.006)
    lines = Star(t, near).join(dates=dates, years=(year, year)).where(F.col("lo_discount").between(*discount) & quantity)
    return lines.agg(money(F.sum(F.col("lo_extendedprice") * F.col("lo_discount")), "revenue"))


_Q1 = "SELECT ROUND(SUM(lo_extendedprice * lo_discount), 2) AS revenue FROM lineorder JOIN date_dim ON d_datekey = lo_orderdate WHERE "


@SSB(_Q1 + "d_year = 1996 AND lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25")
def q1_1(t: Tables) -> DataFrame:
    return _discounted(t, 1996, None, (1, 3), F.col("lo_quantity") < 25)


@SSB(_Q1 + "d_yearmonthnum = 199701 AND lo_discount BETWEEN 4 AND 6 AND lo_quantity BETWEEN 26 AND 35")
def q1_2(t: Tables) -> DataFrame:
    return _discounted(t, 1997, _is("d_yearmonthnum", 199701), (4, 6), F.col("lo_quantity").between(26, 35))


@SSB(_Q1 + "d_weeknuminyear = 6 AND d_year = 1997 AND lo_discount BETWEEN 5 AND 7 AND lo_quantity BETWEEN 26 AND 35")
def q1_3(t: Tables) -> DataFrame:
    return _discounted(t, 1997, _is("d_weeknuminyear", 6), (5, 7), F.col("lo_quantity").between(26, 35))


def _brands(t: Tables, p: Column, region: str) -> DataFrame:
    sold = Star(t).join(s=_is("s_region", region), p=p)
    return sold.groupBy("d_year", "p_brand").agg(money(F.sum("lo_revenue"), "lo_revenue")).orderBy("d_year", "p_brand")


_Q2 = "SELECT CAST(ROUND(SUM(lo_revenue), 2) AS DOUBLE) AS lo_revenue, d_year, p_brand FROM lineorder JOIN date_dim ON d_datekey = lo_orderdate JOIN prod ON p_partkey = lo_partkey JOIN supp ON s_suppkey = lo_suppkey WHERE {} GROUP BY d_year, p_brand ORDER BY d_year, p_brand"


@SSB(_Q2.format("p_category = 'ECONOMY' AND s_region = 'AMERICA'"))
def q2_1(t: Tables) -> DataFrame:
    return _brands(t, _is("p_category", "ECONOMY"), "AMERICA")


@SSB(_Q2.format("p_brand BETWEEN 'Brand#20' AND 'Brand#23' AND s_region = 'ASIA'"))
def q2_2(t: Tables) -> DataFrame:
    return _brands(t, F.col("p_brand").between("Brand#20", "Brand#23"), "ASIA")


@SSB(_Q2.format("p_brand = 'Brand#21' AND s_region = 'EUROPE'"))
def q2_3(t: Tables) -> DataFrame:
    return _brands(t, _is("p_brand", "Brand#21"), "EUROPE")


def _flows(t: Tables, level: str, c: Column, s: Column, years: tuple[int, int], dates: Column | None = None) -> DataFrame:
    keys = [f"c_{level}", f"s_{level}", "d_year"]
    return Star(t).join(dates=dates, years=years, c=c, s=s).groupBy(*keys).agg(money(F.sum("lo_revenue"), "revenue")).orderBy(F.asc("d_year"), F.desc("revenue"), *keys[:2])


_Q3 = "SELECT c_{0}, s_{0}, d_year, CAST(ROUND(SUM(lo_revenue), 2) AS DOUBLE) AS revenue FROM lineorder JOIN cust ON c_custkey = lo_custkey JOIN supp ON s_suppkey = lo_suppkey JOIN date_dim ON d_datekey = lo_orderdate WHERE {1} GROUP BY ALL ORDER BY d_year ASC, revenue DESC, 1, 2"
_CITIES = ("NATION_9_0", "NATION_9_1")
_IN_CITIES = "c_city IN ('NATION_9_0', 'NATION_9_1') AND s_city IN ('NATION_9_0', 'NATION_9_1') AND "


@SSB(_Q3.format("nation", "c_region = 'ASIA' AND s_region = 'ASIA' AND d_year >= 1996 AND d_year <= 2000"))
def q3_1(t: Tables) -> DataFrame:
    return _flows(t, "nation", _is("c_region", "ASIA"), _is("s_region", "ASIA"), (1996, 2000))


@SSB(_Q3.format("city", "c_nation = 'NATION_9' AND s_nation = 'NATION_9' AND d_year BETWEEN 1996 AND 2000"))
def q3_2(t: Tables) -> DataFrame:
    return _flows(t, "city", _is("c_nation", "NATION_9"), _is("s_nation", "NATION_9"), (1996, 2000))


@SSB(_Q3.format("city", _IN_CITIES + "d_year BETWEEN 1996 AND 2000"))
def q3_3(t: Tables) -> DataFrame:
    return _flows(t, "city", _is("c_city", *_CITIES), _is("s_city", *_CITIES), (1996, 2000))


@SSB(_Q3.format("city", _IN_CITIES + "d_yearmonth = 'Dec1997'"))
def q3_4(t: Tables) -> DataFrame:
    return _flows(t, "city", _is("c_city", *_CITIES), _is("s_city", *_CITIES), (1997, 1997), _is("d_yearmonth", "Dec1997"))


def _profits(sold: DataFrame, *keys: str) -> DataFrame:
    return sold.groupBy(*keys).agg(money(F.sum(F.col("lo_revenue") - F.col("lo_supplycost")), "profit")).orderBy(*keys)


_Q4 = "SELECT {0}, CAST(ROUND(SUM(lo_revenue - lo_supplycost), 2) AS DOUBLE) AS profit FROM lineorder JOIN cust ON c_custkey = lo_custkey JOIN supp ON s_suppkey = lo_suppkey JOIN prod ON p_partkey = lo_partkey JOIN date_dim ON d_datekey = lo_orderdate WHERE {1} GROUP BY ALL ORDER BY {0}"


@SSB(_Q4.format("d_year, c_nation", "c_region = 'AMERICA' AND s_region = 'AMERICA' AND (p_mfgr = 'MFGR#1' OR p_mfgr = 'MFGR#2')"))
def q4_1(t: Tables) -> DataFrame:
    return _profits(Star(t).join(c=_is("c_region", "AMERICA"), s=_is("s_region", "AMERICA"), p=_is("p_mfgr", "MFGR#1", "MFGR#2")), "d_year", "c_nation")


@SSB(_Q4.format("d_year, s_nation, p_category", "c_region = 'AMERICA' AND s_region = 'AMERICA' AND d_year IN (1997, 1998) AND p_mfgr IN ('MFGR#1', 'MFGR#2')"))
def q4_2(t: Tables) -> DataFrame:
    return _profits(Star(t).join(years=(1997, 1998), c=_is("c_region", "AMERICA"), s=_is("s_region", "AMERICA"), p=_is("p_mfgr", "MFGR#1", "MFGR#2")), "d_year", "s_nation", "p_category")


@SSB(_Q4.format("d_year, s_city, p_brand", "c_region = (SELECT r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_name = 'NATION_9') AND s_nation = 'NATION_9' AND d_year IN (1997, 1998) AND p_category = 'ECONOMY'"))
def q4_3(t: Tables) -> DataFrame:
    home = t.nation.where(F.col("n_name") == "NATION_9").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("c_region"))
    sold = Star(t).join(years=(1997, 1998), c=_any("c_region"), s=_is("s_nation", "NATION_9"), p=_is("p_category", "ECONOMY"))
    return _profits(sold.join(home, "c_region", "left_semi"), "d_year", "s_city", "p_brand")


@SSB("""SELECT c_nation, p_category, d_year, ROUND(SUM(q), 2) AS sum_quantity, ROUND(SUM(e), 2) AS sum_sales, CAST(SUM(n_orders) AS BIGINT) AS count_distinct_orders, COUNT(c_custkey) AS count_distinct_customers,
 COUNT(CASE WHEN n_orders > 1 THEN c_custkey END) AS count_distinct_repeat_customers, CAST(SUM(n) AS BIGINT) AS count_star
FROM (SELECT c_nation, p_category, d_year, c_custkey, SUM(lo_quantity) AS q, SUM(lo_extendedprice) AS e, COUNT(DISTINCT lo_orderkey) AS n_orders, COUNT(*) AS n FROM lineorder JOIN cust ON c_custkey = lo_custkey JOIN prod ON p_partkey = lo_partkey JOIN date_dim ON d_datekey = lo_orderdate GROUP BY ALL)
GROUP BY ALL ORDER BY 1, 2, 3""")
def qv1_1(t: Tables) -> DataFrame:
    keys = ["c_nation", "p_category", "d_year"]
    # names are long and follow from the customer, so they are looked up once customers are summed; orders are counted after their lines are one row
    deal = max(t.spark.sparkContext.defaultParallelism, -(-t.lineitem.count() // LINES_OF_A_TASK))
    sold = Star(t).join(p=_any("p_partkey"), deal=deal).where("lo_custkey IS NOT NULL AND d_year IS NOT NULL")
    one = sold.groupBy("lo_orderkey", "lo_custkey", "p_category", "d_year").agg(F.sum("lo_quantity").alias("q"), F.sum("lo_extendedprice").alias("e"), F.count("*").alias("n"))
    by_customer = one.groupBy("lo_custkey", "p_category", "d_year").agg(F.sum("q").alias("q"), F.sum("e").alias("e"), F.count("*").alias("n_orders"), F.sum("n").alias("n"))
    people = Star(t).people("c").where(_any("c_nation")).groupBy("c_custkey", "c_nation").agg(F.count("*").alias("times"))
    each = by_customer.join(people, F.col("lo_custkey") == F.col("c_custkey")).withColumns({k: F.col(k) * F.col("times") for k in ("q", "e", "n")})
    return (
        each.groupBy(*keys)
        .agg(
            money(F.sum("q"), "sum_quantity"),
            money(F.sum("e"), "sum_sales"),
            F.sum("n_orders").alias("count_distinct_orders"),
            F.count("c_custkey").alias("count_distinct_customers"),
            F.count(F.when(F.col("n_orders") > 1, F.col("c_custkey"))).alias("count_distinct_repeat_customers"),
            F.sum("n").alias("count_star"),
        )
        .orderBy(*keys)
    )
