"""The relational families over the star schema: customers as projects, orders as revisions, lines as
mentions, events as claims, customer to supplier as citation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.session import table


def _t(s: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [table(s, sf, n) for n in names]


def revenue_by_status(s, sf) -> DataFrame:
    (line,) = _t(s, sf, "lineitem")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(price).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"))


def customers_without_orders(s, sf) -> DataFrame:
    customer, orders = _t(s, sf, "customer", "orders")
    return customer.join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


def customers_with_large_orders(s, sf) -> DataFrame:
    customer, orders = _t(s, sf, "customer", "orders")
    large = orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return customer.join(large, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


def order_history(s, sf) -> DataFrame:
    """Depth, first, last and days of each customer's orders, with a bucket."""
    (orders,) = _t(s, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    h = orders.groupBy("o_custkey").agg(F.count("*").alias("depth"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    bucket = F.when(F.col("depth") == 1, "single").when(F.col("depth") <= 3, "mid").otherwise("deep")
    return h.withColumns({"days": F.datediff("last_day", "first_day"), "bucket": bucket})


def monthly_running_revenue(s, sf) -> DataFrame:
    (orders,) = _t(s, sf, "orders")
    per = orders.groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return per.select("o_orderpriority", "month", F.sum("n").over(Window.partitionBy("o_orderpriority").orderBy("month")).alias("cumulative"))


def top_orders_of_customers(s, sf) -> DataFrame:
    from quillon.operators.ranking import first_k

    (orders,) = _t(s, sf, "orders")
    return first_k(orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


def claims_by_type(s, sf) -> DataFrame:
    (events,) = _t(s, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.groupBy("user_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("event_type") == t).alias(t) for t in ("click", "error", "purchase", "signup", "view")), F.sum(k).alias("sum_k"))


def busiest_type(s, sf) -> DataFrame:
    """Each user's most frequent type, the first by name among equals."""
    (events,) = _t(s, sf, "events")
    votes = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return votes.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("event_type"), F.sum("n").alias("total"))


def weekly_events(s, sf) -> DataFrame:
    (events,) = _t(s, sf, "events")
    return events.groupBy(F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum("value").alias("value"))


def co_supply(s, sf) -> DataFrame:
    """Pairs of suppliers that share an order: a self join on the order with an inequality."""
    (line,) = _t(s, sf, "lineitem")
    have = line.select("l_orderkey", "l_suppkey").distinct()
    pairs = have.select("l_orderkey", F.col("l_suppkey").alias("a")).join(have.select("l_orderkey", F.col("l_suppkey").alias("b")), "l_orderkey").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where("shared >= 2")


def either_end(s, sf) -> DataFrame:
    """Rows of a key at either end of an edge: a disjunction written as a union of two equi-joins."""
    line, orders, nation = _t(s, sf, "lineitem", "orders", "nation")
    edge = line.where("l_quantity >= 50").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).where("src <> dst").distinct()
    ends = edge.select(F.col("src").alias("node"), "src", "dst").unionAll(edge.select("dst", "src", "dst"))
    return ends.distinct().groupBy("node").agg(F.count("*").alias("edges"))


def revenue_by_region(s, sf) -> DataFrame:
    """Dimensions are small and fixed, so Spark broadcasts them by their size; the facts join by key."""
    line, orders, customer, nation, region = _t(s, sf, "lineitem", "orders", "customer", "nation", "region")
    dims = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name", "n_name")
    fact = line.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v")).groupBy("l_orderkey").agg(F.sum("v").alias("v"))
    return fact.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(dims, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name", "n_name").agg(F.sum("v").alias("revenue"), F.count("*").alias("orders"))


def segment_trend(s, sf) -> DataFrame:
    """The slope of yearly mean order price for each segment."""
    orders, customer = _t(s, sf, "orders", "customer")
    per = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("p"))
    return per.groupBy("c_mktsegment").agg(F.regr_slope("p", F.col("y").cast("double")).alias("slope"), F.count("*").alias("years"))


def part_brands_listed(s, sf) -> DataFrame:
    (part,) = _t(s, sf, "part")
    return part.groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_type")), ", ").alias("types"), F.count("*").alias("n"))


QUERIES = {f"star_{f.__name__}": f for f in (
    revenue_by_status, customers_without_orders, customers_with_large_orders, order_history, monthly_running_revenue, top_orders_of_customers, claims_by_type, busiest_type, weekly_events, co_supply, either_end, revenue_by_region, segment_trend, part_brands_listed,
)}
SQL = {
    "star_revenue_by_status": "SELECT l_returnflag, l_linestatus, sum(l_quantity) sum_qty, sum(l_extendedprice * (1 - l_discount)) revenue, avg(l_discount) avg_disc, count(*) n FROM lineitem GROUP BY 1, 2",
    "star_customers_without_orders": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "star_customers_with_large_orders": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "star_order_history": "SELECT *, CAST(last_day - first_day AS INTEGER) AS days, CASE WHEN depth = 1 THEN 'single' WHEN depth < 4 THEN 'mid' ELSE 'deep' END bucket FROM (SELECT o_custkey, count(*) depth, min(o_orderdate::DATE) first_day, max(o_orderdate::DATE) last_day FROM orders GROUP BY 1)",
    "star_monthly_running_revenue": "SELECT o_orderpriority, month, CAST(sum(n) OVER (PARTITION BY o_orderpriority ORDER BY month) AS BIGINT) cumulative FROM (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, count(*) n FROM orders GROUP BY 1, 2)",
    "star_top_orders_of_customers": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) < 4",
    "star_claims_by_type": "SELECT user_id, count(*) total, count_if(event_type = 'click') click, count_if(event_type = 'error') error, count_if(event_type = 'purchase') purchase, count_if(event_type = 'signup') signup, count_if(event_type = 'view') AS view, CAST(sum(json_extract_string(props, '$.k')::BIGINT) AS BIGINT) sum_k FROM events GROUP BY 1",
    "star_busiest_type": "SELECT user_id, first(event_type ORDER BY n DESC, event_type) event_type, sum(n)::BIGINT total FROM (SELECT user_id, event_type, count(*) n FROM events GROUP BY 1, 2) GROUP BY 1",
    "star_weekly_events": "SELECT date_trunc('week', ts)::DATE AS week, count(*) n, count(DISTINCT user_id) users, sum(value) AS value FROM events GROUP BY 1",
    "star_co_supply": "WITH h AS (SELECT DISTINCT l_orderkey k, l_suppkey s FROM lineitem) SELECT x.s a, y.s b, count(*) shared FROM h x JOIN h y ON x.k = y.k AND x.s < y.s GROUP BY 1, 2 HAVING count(*) > 1",
    "star_either_end": "WITH e AS (SELECT DISTINCT o_custkey src, l_suppkey dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 50 AND o_custkey <> l_suppkey), n AS (SELECT src node FROM e UNION SELECT dst FROM e) SELECT node, count(*) edges FROM n JOIN e ON node = src OR node = dst GROUP BY 1",
    "star_revenue_by_region": "SELECT r_name, n_name, sum(v) revenue, count(*) orders FROM (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) v FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2",
    "star_segment_trend": "SELECT c_mktsegment, regr_slope(p, y) slope, count(*) AS years FROM (SELECT c_mktsegment, year(o_orderdate)::DOUBLE y, avg(o_totalprice) p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1",
    "star_part_brands_listed": "SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) types, count(*) n FROM part GROUP BY 1",
}
