"""Statements as text, run by the session: the same words go to both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lakeweave.plans import Entry, Registry
from lakeweave.session import Engine
from lakeweave.sources.catalog import Tables

SQL = Registry("sql_")

TEXTS = {
    "h07": """
SELECT supp_nation, cust_nation, l_year, ROUND(SUM(volume), 2) AS revenue
FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, strftime('%Y', l_shipdate) AS l_year, l_extendedprice * (1 - l_discount) AS volume
      FROM supplier, lineitem, orders, customer, nation n1, nation n2
      WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
        AND ((n1.n_name = 'NATION_3' AND n2.n_name = 'NATION_8') OR (n1.n_name = 'NATION_8' AND n2.n_name = 'NATION_3')) -- both ways
        AND CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') AS shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY 1, 2, 3""",
    "h08": """
/* the share of a nation in its region's market, by year */
SELECT o_year, ROUND(SUM(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / SUM(volume), 6) AS mkt_share
FROM (SELECT strftime('%Y', o_orderdate) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
      FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
      WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey
        AND r_name = 'ASIA' AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY') AS all_nations
GROUP BY o_year ORDER BY o_year""",
    "h09": """
SELECT nation, o_year, ROUND(SUM(amount), 2) AS sum_profit
FROM (SELECT n_name AS nation, strftime('%Y', o_orderdate) AS o_year, l_extendedprice * (1 - l_discount) - 0.6 * l_extendedprice AS amount
      FROM part, supplier, lineitem, orders, nation
      WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%e%') AS profit
GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
    "implicit_dates": "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1998-01-01' AND o_orderdate < '1998-02-01'",
}


def _run(text: str):
    def run(t: Tables) -> DataFrame:
        return Engine(t.spark, t.root).sql(text).df

    return run


for _name, _text in TEXTS.items():
    SQL[f"sql_{_name}"] = Entry(_run(_text), _text)
