"""Query shapes carried by the text-to-SQL corpora.

The corpora only *contain* these SQL strings as training labels; here each
shape runs as a DataFrame plan over the test tables.  Money is summed as
DECIMAL(18,2) (exact, order-independent); averages are exact sums divided
once.  Every LIMIT has a unique tie-break column in its ORDER BY.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenlake.sources.tables import table

MONEY = "decimal(18,2)"


def _t(spark, sf_dir, name):
    return table(spark, sf_dir, name)


def money(c: str):
    return F.col(c).cast(MONEY)


def in_year(c: str, year: int):
    """YEAR(c) = year as a half-open range, which reaches the scan."""
    return (F.col(c) >= F.lit(f"{year}-01-01").cast("date")) & (F.col(c) < F.lit(f"{year + 1}-01-01").cast("date"))


def k1_select_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: ``SELECT * FROM nation``."""
    return _t(spark, sf_dir, "nation")


# Progressive predicates of K2 (turn k = conjunction of the first k).
K2_PREDICATES = [
    ("o_orderstatus = 'F'", lambda: F.col("o_orderstatus") == "F"),
    ("o_totalprice > 100000", lambda: F.col("o_totalprice") > 100000),
    ("year(o_orderdate) = 1996", lambda: in_year("o_orderdate", 1996)),
]


def k2_progressive_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 (+ W9): rows of each turn; turn k filters by the first k
    predicates.  Every turn contains the first predicate, so it is pushed
    into the single Parquet scan and each surviving row emits the turns
    whose remaining predicates it meets (one scan instead of one per turn)."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    preds = [p() for _, p in K2_PREDICATES]
    first = o.filter(preds[0])
    turns, cond = [F.lit(1)], F.lit(True)
    for k, p in enumerate(preds[1:], start=2):
        cond = cond & p
        turns.append(F.when(cond, F.lit(k)))
    return first.select(F.explode(F.filter(F.array(*turns), lambda t: t.isNotNull())).alias("turn"),
                        "o_orderkey")


def k3_count_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: COUNT(*), with a predicate and with BETWEEN."""
    o = _t(spark, sf_dir, "orders")
    d = F.to_date("o_orderdate")
    return o.agg(F.count(F.lit(1)).alias("n_orders"),
                 F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("n_urgent"),
                 F.count(F.when(d.between(F.lit("1996-01-01").cast("date"),
                                          F.lit("1996-12-31").cast("date")), 1)).alias("n_1996"))


def k4_order_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: filtered customers ordered by balance desc (tie: key)."""
    c = _t(spark, sf_dir, "customer")
    return c.filter((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 0)) \
            .select("c_custkey", "c_name", "c_acctbal") \
            .orderBy(F.col("c_acctbal").desc(), F.col("c_custkey"))


def k5_year_count_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: YEAR(date) = y, COUNT then SUM."""
    o = _t(spark, sf_dir, "orders").filter(in_year("o_orderdate", 1996))
    return o.agg(F.count(F.lit(1)).alias("n_orders"), F.sum(money("o_totalprice")).alias("total_price"))


def k6_stacked_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: SUM -> AVG with stacked filters."""
    li = _t(spark, sf_dir, "lineitem").filter(
        (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05) & (F.col("l_quantity") < 24))
    g = li.agg(F.sum(money("l_extendedprice")).alias("sum_price"), F.count(F.lit(1)).alias("n"))
    return g.select("sum_price", "n", F.try_divide(F.col("sum_price").cast("double"),
                                                   F.col("n").cast("double")).alias("avg_price"))


def k7_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: GROUP BY count ordered by count."""
    c = _t(spark, sf_dir, "customer")
    return c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_customers")) \
            .orderBy(F.col("n_customers").desc(), F.col("c_mktsegment"))


def k8_top_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: top-5 brands by average retail price (argmax = first row)."""
    p = _t(spark, sf_dir, "part")
    g = p.groupBy("p_brand").agg(F.sum(money("p_retailprice")).alias("s"), F.count(F.lit(1)).alias("n"))
    g = g.select("p_brand", "n", (F.col("s").cast("double") / F.col("n").cast("double")).alias("avg_price"))
    return g.orderBy(F.col("avg_price").desc(), F.col("p_brand")).limit(5)


def k9_top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: join + group + top-5 customers by number of orders.  Orders are
    aggregated per customer before the join (partial aggregation, the
    customer side is joined to at most one row per key)."""
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("num_orders"))
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    j = c.join(o, c["c_custkey"] == o["o_custkey"])
    return j.select("c_custkey", "c_name", "num_orders") \
            .orderBy(F.col("num_orders").desc(), F.col("c_custkey")).limit(5)


def k10_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join + AVG per part, HAVING COUNT >= 10."""
    li = _t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum(money("l_quantity")).alias("q"), F.count(F.lit(1)).alias("n_lines"))
    li = li.filter(F.col("n_lines") >= 10)
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    j = p.join(li, p["p_partkey"] == li["l_partkey"])
    return j.select("p_partkey", "p_name", "p_brand", "n_lines",
                    (F.col("q").cast("double") / F.col("n_lines").cast("double")).alias("avg_quantity"))


def k11_nation_top(spark: SparkSession, sf_dir: str, nation: str = "NATION_24") -> DataFrame:
    """Customers of one nation, total spent, top 10."""
    n = _t(spark, sf_dir, "nation").filter(F.col("n_name") == nation).select("n_nationkey")
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    c = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left_semi")
    # only the nation's orders are aggregated
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").join(c, F.col("o_custkey") == c["c_custkey"], "left_semi")
    o = o.groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("total_spent"))
    j = c.join(o, c["c_custkey"] == o["o_custkey"])
    return j.select("c_custkey", "c_name", "total_spent") \
            .orderBy(F.col("total_spent").desc(), F.col("c_custkey")).limit(10)


def _monthly(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.sum(money("o_totalprice")).alias("monthly_revenue"))


def k12_best_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month bucket with the highest revenue."""
    return _monthly(spark, sf_dir).orderBy(F.col("monthly_revenue").desc(), F.col("month")).limit(1)


def k13_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``SUM(SUM(x)) OVER (ORDER BY month)``; the window runs after
    the monthly aggregate (one row per month), so one partition is fine."""
    m = _monthly(spark, sf_dir)
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.select("month", "monthly_revenue", F.sum("monthly_revenue").over(w).alias("running_total"))


def k14_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who ordered (semi join) but never had an 'F' order
    (anti join)."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    has = c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi")
    f = o.filter(F.col("o_orderstatus") == "F")
    return has.join(f, has["c_custkey"] == f["o_custkey"], "left_anti")


SQL = {
    "k1_select_all": "SELECT * FROM nation",
    "k2_progressive_where": """
        SELECT 1 AS turn, o_orderkey FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT 2, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000
        UNION ALL SELECT 3, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000
                                                   AND year(o_orderdate) = 1996""",
    "k3_count_between": """
        SELECT count(*) AS n_orders, count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS n_urgent,
               count(CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'
                          THEN 1 END) AS n_1996
        FROM orders""",
    "k4_order_by": """
        SELECT c_custkey, c_name, c_acctbal FROM customer
        WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey""",
    "k5_year_count_sum": """
        SELECT count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total_price
        FROM orders WHERE year(o_orderdate) = 1996""",
    "k6_stacked_avg": """
        SELECT sum_price, n, CAST(sum_price AS DOUBLE) / NULLIF(CAST(n AS DOUBLE), 0) AS avg_price
        FROM (SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS sum_price, count(*) AS n FROM lineitem
              WHERE l_returnflag = 'R' AND l_discount > 0.05 AND l_quantity < 24)""",
    "k7_group_count": """
        SELECT c_mktsegment, count(*) AS n_customers FROM customer GROUP BY c_mktsegment
        ORDER BY n_customers DESC, c_mktsegment""",
    "k8_top_brands": """
        SELECT p_brand, n, CAST(s AS DOUBLE) / CAST(n AS DOUBLE) AS avg_price
        FROM (SELECT p_brand, sum(CAST(p_retailprice AS DECIMAL(18,2))) AS s, count(*) AS n
              FROM part GROUP BY p_brand)
        ORDER BY avg_price DESC, p_brand LIMIT 5""",
    "k9_top_customers": """
        SELECT c_custkey, c_name, num_orders
        FROM customer JOIN (SELECT o_custkey, count(*) AS num_orders FROM orders GROUP BY o_custkey) o
             ON c_custkey = o.o_custkey
        ORDER BY num_orders DESC, c_custkey LIMIT 5""",
    "k10_having": """
        SELECT p_partkey, p_name, p_brand, n_lines, CAST(q AS DOUBLE) / CAST(n_lines AS DOUBLE) AS avg_quantity
        FROM part JOIN (SELECT l_partkey, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q, count(*) AS n_lines
                        FROM lineitem GROUP BY l_partkey HAVING count(*) >= 10) l ON p_partkey = l.l_partkey""",
    "k11_nation_top": """
        SELECT c_custkey, c_name, total_spent
        FROM customer JOIN (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total_spent
                            FROM orders GROUP BY o_custkey) o ON c_custkey = o.o_custkey
        WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_24')
        ORDER BY total_spent DESC, c_custkey LIMIT 10""",
    "k12_best_month": """
        SELECT strftime(o_orderdate, '%Y-%m') AS month,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS monthly_revenue
        FROM orders GROUP BY month ORDER BY monthly_revenue DESC, month LIMIT 1""",
    "k13_running_total": """
        SELECT month, monthly_revenue,
               sum(monthly_revenue) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                 AS running_total
        FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month,
                     CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS monthly_revenue
              FROM orders GROUP BY month)""",
    "k14_semi_anti": """
        SELECT c_custkey, c_name FROM customer c
        WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
          AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')""",
}

QUERIES = {
    "k1_select_all": k1_select_all,
    "k2_progressive_where": k2_progressive_where,
    "k3_count_between": k3_count_between,
    "k4_order_by": k4_order_by,
    "k5_year_count_sum": k5_year_count_sum,
    "k6_stacked_avg": k6_stacked_avg,
    "k7_group_count": k7_group_count,
    "k8_top_brands": k8_top_brands,
    "k9_top_customers": k9_top_customers,
    "k10_having": k10_having,
    "k11_nation_top": k11_nation_top,
    "k12_best_month": k12_best_month,
    "k13_running_total": k13_running_total,
    "k14_semi_anti": k14_semi_anti,
}
