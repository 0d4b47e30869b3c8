"""Star-schema queries; each returns a DataFrame and has a SQL twin in ``SQL``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.session import table


def _year(column: str, year: int):
    """Whole-year range on a timestamp column, in the form that reaches the Parquet scan."""
    return f"{column} >= timestamp_ntz'{year}-01-01' and {column} < timestamp_ntz'{year + 1}-01-01'"


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def revenue_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounted revenue of 1996's orders by market segment."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").where(_year("o_orderdate", 1996)).select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment")
        .agg(F.round(F.sum(_revenue()), 2).alias("revenue"), F.count("*").alias("n_lines"))
    )


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and means of shipped lines by return flag and status; one partial aggregate before the shuffle."""
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'2000-09-02'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(_revenue()), 2).alias("sum_disc_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("count_order"),
    )


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten orders of most revenue; each task keeps ten rows, so no global sort."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(_revenue()), 2).alias("revenue"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    best = lines.orderBy(F.desc("revenue"), "l_orderkey").limit(10)
    return best.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "revenue", "o_orderdate", "o_orderpriority")


def idle_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order in 1996 (anti join)."""
    orders = table(spark, sf_dir, "orders").where(_year("o_orderdate", 1996)).select("o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


def urgent_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an urgent order (semi join)."""
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


def balance_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of every region, outer-joined."""

    def by_region(name: str, prefix: str, key: str) -> DataFrame:
        nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
        rows = table(spark, sf_dir, name).join(nation, F.col(f"{prefix}_nationkey") == F.col("n_nationkey"))
        return rows.groupBy(F.col("n_regionkey").alias(key)).agg(F.count("*").alias(f"n_{name}s"), F.round(F.sum(f"{prefix}_acctbal"), 2).alias(f"{prefix}_balance"))

    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    customers, suppliers = by_region("customer", "c", "ck"), by_region("supplier", "s", "sk")
    return region.join(customers, F.col("r_regionkey") == F.col("ck"), "left").join(suppliers, F.col("r_regionkey") == F.col("sk"), "left").drop("ck", "sk")


def quantity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by flag and status, with subtotals and the total."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.grouping_id().cast("int").alias("level"))


def orders_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts by status and priority over every combination of the two."""
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def orders_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("o_year", F.year("o_orderdate"))
    return spark.sql(
        "SELECT o_orderstatus, o_year, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_year), ())",
        orders=orders,
    )


def distinct_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts by priority."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("buyers"), F.count_distinct(F.to_date("o_orderdate")).alias("days"))


def approximate_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketched distinct counts by priority, within two hundredths (relative standard deviation)."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.approx_count_distinct("o_custkey", 0.02).alias("buyers"))


def brand_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest part of each brand, ties to the smallest key, without a window's sort."""
    parts = table(spark, sf_dir, "part")
    best = F.max_by(F.struct("p_partkey", "p_name"), F.struct("p_retailprice", -F.col("p_partkey")))
    return parts.groupBy("p_brand").agg(best.alias("b"), F.max("p_retailprice").alias("price"), F.min("p_size").alias("least_size")).select("p_brand", "b.p_partkey", "b.p_name", "price", "least_size")


def flag_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by flag (rows) and status (columns)."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).withColumnsRenamed({"F": "n_f", "O": "n_o"})


def nations_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of rich customers or suppliers, each once."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("nation"))
    return c.unionByName(s).distinct()


def nations_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    return c.intersect(s)


def nations_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations less suppliers' nations, as bags."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return c.exceptAll(s)


def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String, date and number functions."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.upper(F.substring("o_orderpriority", 3, 20)).alias("priority"),
        F.concat_ws("/", F.year("o_orderdate"), F.month("o_orderdate")).alias("month"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate")).alias("age"),
        F.round(F.sqrt("o_totalprice"), 4).alias("root"),
        F.floor(F.col("o_totalprice") / 1000).cast("long").alias("thousands"),
        F.when(F.col("o_totalprice") > 200000, "large").otherwise("small").alias("size_class"),
        F.length(F.trim(F.concat(F.lit("  "), "o_orderstatus"))).alias("len"),
    )


def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's two latest orders, by a lateral subquery over orders numbered by a window.

    An ORDER BY with LIMIT inside the subquery would become a sort before the shuffle by customer, which doesn't keep it.
    """
    return spark.sql(
        """
        WITH numbered AS (
            SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey NULLS LAST) AS r FROM {orders})
        SELECT c_custkey, t.o_orderkey, t.o_totalprice
        FROM (SELECT DISTINCT c_custkey FROM {customer}) c, LATERAL (SELECT o_orderkey, o_totalprice FROM numbered WHERE o_custkey = c.c_custkey AND r <= 2) t
        """,
        customer=table(spark, sf_dir, "customer"),
        orders=table(spark, sf_dir, "orders"),
    )


def shipping_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive common table expression: the calendar of 1996's months, with their orders."""
    return spark.sql(
        """
        WITH RECURSIVE months(m) AS (SELECT 1 UNION ALL SELECT m + 1 FROM months WHERE m < 12)
        SELECT m AS month, count(o_orderkey) AS n_orders
        FROM months LEFT JOIN (SELECT o_orderkey, month(o_orderdate) AS om FROM {orders} WHERE o_orderdate >= TIMESTAMP_NTZ '1996-01-01' AND o_orderdate < TIMESTAMP_NTZ '1997-01-01') ON m = om
        GROUP BY m
        """,
        orders=table(spark, sf_dir, "orders"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        revenue_by_segment, pricing_summary, top_orders, idle_customers, urgent_customers, balance_by_region, quantity_rollup, orders_cube, orders_grouping_sets,
        distinct_buyers, approximate_buyers, brand_extremes, flag_pivot, nations_union, nations_intersect, nations_except_all, order_labels, latest_orders, shipping_chain,
    )
}

SQL = {
    "revenue_by_segment": """
        SELECT c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'
        GROUP BY c_mktsegment
    """,
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
            round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag, l_linestatus
    """,
    "top_orders": """
        SELECT l_orderkey, revenue, o_orderdate, o_orderpriority FROM (
            SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_orderkey
            ORDER BY revenue DESC, l_orderkey LIMIT 10) JOIN orders ON l_orderkey = o_orderkey
    """,
    "idle_customers": """
        SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (
            SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01')
    """,
    "urgent_customers": """
        SELECT c_custkey, c_name, c_nationkey FROM customer
        WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
    """,
    "balance_by_region": """
        SELECT r_regionkey, r_name, n_customers, c_balance, n_suppliers, s_balance FROM region
        LEFT JOIN (SELECT n_regionkey AS ck, count(*) AS n_customers, round(sum(c_acctbal), 2) AS c_balance
            FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey) ON r_regionkey = ck
        LEFT JOIN (SELECT n_regionkey AS sk, count(*) AS n_suppliers, round(sum(s_acctbal), 2) AS s_balance
            FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey) ON r_regionkey = sk
    """,
    "quantity_rollup": """
        SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, CAST(grouping(l_returnflag, l_linestatus) AS INTEGER) AS level
        FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
    """,
    "orders_cube": """
        SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus, o_orderpriority) AS INTEGER) AS level
        FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
    """,
    "orders_grouping_sets": """
        SELECT o_orderstatus, o_year, count(*) AS n
        FROM (SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS o_year FROM orders)
        GROUP BY GROUPING SETS ((o_orderstatus), (o_year), ())
    """,
    "distinct_buyers": """
        SELECT o_orderpriority, count(DISTINCT o_custkey) AS buyers, count(DISTINCT CAST(o_orderdate AS DATE)) AS days
        FROM orders GROUP BY o_orderpriority
    """,
    "brand_extremes": """
        SELECT p_brand, p_partkey, p_name, p_retailprice AS price, least_size FROM (
            SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r,
                min(p_size) OVER (PARTITION BY p_brand) AS least_size FROM part) WHERE r = 1
    """,
    "flag_pivot": """
        SELECT l_returnflag, nullif(count(*) FILTER (l_linestatus = 'F'), 0) AS n_f, nullif(count(*) FILTER (l_linestatus = 'O'), 0) AS n_o
        FROM lineitem GROUP BY l_returnflag
    """,
    "nations_union": """
        SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000
        UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000
    """,
    "nations_intersect": """
        SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000
        INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000
    """,
    "nations_except_all": "SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "order_labels": """
        SELECT o_orderkey, upper(substring(o_orderpriority, 3, 20)) AS priority,
            concat_ws('/', year(o_orderdate), month(o_orderdate)) AS month, strftime(o_orderdate, '%Y-%m-%d') AS day,
            CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER) AS age,
            round(sqrt(o_totalprice), 4) AS root, CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands,
            CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS size_class,
            CAST(length(trim('  ' || o_orderstatus)) AS INTEGER) AS len
        FROM orders
    """,
    "latest_orders": """
        SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice FROM (
            SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders)
        WHERE r <= 2 AND o_custkey IN (SELECT c_custkey FROM customer)
    """,
    "shipping_chain": """
        SELECT CAST(m AS INTEGER) AS month, count(o_orderkey) AS n_orders FROM range(1, 13) t(m)
        LEFT JOIN (SELECT o_orderkey, month(o_orderdate) AS om FROM orders WHERE year(o_orderdate) = 1996) ON m = om GROUP BY m
    """,
}
