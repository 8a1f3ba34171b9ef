"""The relational query corpus over the star schema: scans, expressions, groups, windows, joins, reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.operators import frames, temporal
from lexigrove.operators.scans import Parts, numbered
from lexigrove.plans.registry import Tables, query
from lexigrove.sources import database
from lexigrove.sources.scratch import cut, scratch_path


def money(x: str | Column) -> Column:
    """Exact sum of amounts with two decimals."""
    return F.sum((F.col(x) if isinstance(x, str) else x).cast("decimal(18,2)")).cast("double")


MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"

# ------------------------------------------------------------- scans and sinks


@query("b01_scan_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey > 1")
def b01(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    t.nation.select("n_nationkey", "n_name", "n_regionkey").write.csv(path, header=True)
    return t.spark.read.csv(path, header=True, inferSchema=True).filter("n_regionkey > 1")


@query("b02_sink_parquet", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def b02(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "parquet")
    t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").write.parquet(path)
    return t.spark.read.parquet(path)


@query("b03_scan_parquet_select", "SELECT n_name FROM nation")
def b03(t: Tables) -> DataFrame:
    return t.nation.select("n_name")


@query("b11_csv_schema", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def b11(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    t.region.select("r_regionkey", "r_name").write.csv(path, header=True)
    return t.spark.read.schema("r_regionkey bigint, r_name string").csv(path, header=True)


@query("b12_scan_ndjson", "SELECT n_name, n_nationkey::BIGINT AS n_nationkey FROM nation")
def b12(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "ndjson")
    t.nation.select("n_name", "n_nationkey").write.json(path)
    return t.spark.read.schema("n_name string, n_nationkey bigint").json(path)


@query("b13_csv_glob", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 2")
def b13(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "glob")
    for r in (0, 1):
        t.nation.filter(F.col("n_regionkey") == r).select("n_nationkey", "n_name").write.csv(f"{path}/part_{r}", header=True)
    return t.spark.read.schema("n_nationkey int, n_name string").csv(f"{path}/part_*", header=True)


@query("b14_out_of_core", f"SELECT l_suppkey, count(*) AS n, {MONEY.format('l_extendedprice')} AS total FROM lineitem GROUP BY l_suppkey")
def b14(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), money("l_extendedprice").alias("total"))


@query("b15_sink_csv", "SELECT s_suppkey, s_name FROM supplier")
def b15(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    t.supplier.select("s_suppkey", "s_name").write.csv(path, header=True)
    return t.spark.read.schema("s_suppkey bigint, s_name string").csv(path, header=True)


@query("b49_read_database", "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def b49(t: Tables) -> DataFrame:
    held = cut(database.databases(t.nation.selectExpr("n_nationkey AS id", "n_name AS name"), "users"), "databases")
    return database.query_databases(held, "SELECT id, name FROM users", "id bigint, name string")


@query("b49_query_databases", "SELECT c_custkey::BIGINT AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def b49_many(t: Tables) -> DataFrame:
    """Customers in databases of their own, one for each part of the table; each answers for itself."""
    held = cut(database.databases(t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").repartition("c_custkey"), "customers"), "databases")
    return database.query_databases(held, "SELECT c_custkey, c_name, c_acctbal FROM customers WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'", "id bigint, name string, balance double")


# ----------------------------------------------------------------- expressions


@query("b04_mean_alias", "SELECT round(avg(l_extendedprice), 4) AS avg_price FROM lineitem")
def b04(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.round(F.avg("l_extendedprice"), 4).alias("avg_price"))


@query("b05_cast", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders")
def b05(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.col("o_totalprice").cast("bigint").alias("whole"))


@query("b06_when_then", "SELECT c_custkey, CASE WHEN c_acctbal > 3000 THEN 'old' ELSE 'young' END AS kind FROM customer")
def b06(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 3000, "old").otherwise("young").alias("kind"))


@query("b16_fill_null", "SELECT d.doc_id, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def b16(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"))


@query("b17_arithmetic", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax, 4) AS net, (l_quantity > 10 AND NOT l_discount > 0.05) AS big, round(l_quantity ** 2, 4) AS squared FROM lineitem")
def b17(t: Tables) -> DataFrame:
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) + F.col("l_tax"), 4)
    return t.lineitem.select("l_orderkey", "l_linenumber", net.alias("net"), ((F.col("l_quantity") > 10) & ~(F.col("l_discount") > 0.05)).alias("big"), F.round(F.pow("l_quantity", F.lit(2)), 4).alias("squared"))


@query("b18_not_null", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL")
def b18(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").filter(F.col("toxic").isNotNull()).select("doc_id", "toxic")


@query("b22_chained_when", "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'excellent' WHEN p_size >= 20 THEN 'pass' ELSE 'fail' END AS grade FROM part")
def b22(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.when(F.col("p_size") >= 40, "excellent").when(F.col("p_size") >= 20, "pass").otherwise("fail").alias("grade"))


@query("b31_str_contains", "SELECT p_partkey, regexp_matches(p_type, '^[A-M].*E') AS rx, contains(p_name, '1') AS lit FROM part")
def b31(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.col("p_type").rlike("^[A-M].*E").alias("rx"), F.contains("p_name", F.lit("1")).alias("lit"))


@query("b32_split_len", "SELECT doc_id, len(string_split(text, ' '))::INT AS n FROM documents")
def b32(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(F.split("text", r"\Q \E", -1)).alias("n"))


@query("b32x_string_functions", "SELECT p_partkey, length(p_name)::INT AS chars, strlen(p_name)::INT AS bytes, upper(p_name) AS up, lower(p_type) AS low, substr(p_name, 2, 4) AS cut, CASE WHEN strpos(p_name, 'a') > 0 THEN substr(p_name, 1, strpos(p_name, 'a') - 1) || 'A' || substr(p_name, strpos(p_name, 'a') + 1) ELSE p_name END AS first_a FROM part")
def b32x(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", F.length("p_name").alias("chars"), F.octet_length("p_name").alias("bytes"), F.upper("p_name").alias("up"), F.lower("p_type").alias("low"),
        F.substring("p_name", 2, 4).alias("cut"), frames.replace_first(F.col("p_name"), "a", "A").alias("first_a"),
    )


@query("b33_year_month", "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, isodow(o_orderdate)::INT AS wd FROM orders")
def b33(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), (F.weekday("o_orderdate") + 1).alias("wd"))


@query("b34_truncate", "SELECT event_id, date_trunc('month', ts)::TIMESTAMP AS month FROM events")
def b34(t: Tables) -> DataFrame:
    return t.events.select("event_id", temporal.truncate(F.col("ts"), "1mo").alias("month"))


@query("b35_offset_by", "SELECT event_id, ts + INTERVAL 1 DAY AS next_day, ts + INTERVAL 1 MONTH AS next_month FROM events")
def b35(t: Tables) -> DataFrame:
    return t.events.select("event_id", temporal.offset_by(F.col("ts"), "1d").alias("next_day"), temporal.offset_by(F.col("ts"), "1mo").alias("next_month"))


@query("b36_list_eval", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x * 2)::DOUBLE)), 4) AS doubled, list_contains(list_transform(embedding, lambda x: x > 0), true) AS any_positive FROM embeddings")
def b36(t: Tables) -> DataFrame:
    doubled = F.transform("embedding", lambda x: (x * 2).cast("double"))
    return t.embeddings.select("vec_id", F.round(F.aggregate(doubled, F.lit(0.0), lambda a, x: a + x), 4).alias("doubled"), F.array_contains(F.transform("embedding", lambda x: x > 0), True).alias("any_positive"))


@query("b37_struct_field", "SELECT p_partkey, p_size AS x FROM part")
def b37(t: Tables) -> DataFrame:
    held = t.part.select("p_partkey", F.struct(F.col("p_size").alias("x"), F.col("p_brand").alias("y")).alias("data"))
    return held.select("p_partkey", F.col("data.x").alias("x"))


@query("b38_categorical", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority)::INT - 1 AS code FROM orders")
def b38(t: Tables) -> DataFrame:
    return frames.categories(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code").select("o_orderkey", "code")


# -------------------------------------------------- aggregation, windows, time


@query("b07_mean_over", "SELECT p_partkey, round(avg(p_retailprice) OVER (PARTITION BY p_brand), 4) AS brand_mean FROM part")
def b07(t: Tables) -> DataFrame:
    rows = frames.over(t.part.select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], brand_mean=F.avg("p_retailprice"))
    return rows.select("p_partkey", F.round("brand_mean", 4).alias("brand_mean"))


@query("b08_group_sum", f"SELECT l_returnflag, {MONEY.format('l_quantity')} AS total FROM lineitem GROUP BY l_returnflag")
def b08(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(money("l_quantity").alias("total"))


@query("b19_diff", "SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER w, 4) AS change, lead(o_orderkey) OVER w AS following FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def b19(t: Tables) -> DataFrame:
    by, order = ["o_custkey"], ["o_orderdate", "o_orderkey"]
    rows = frames.shift(t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), by, order, before=(1, "o_totalprice"), following=(-1, "o_orderkey"))
    return rows.select("o_orderkey", F.round(F.col("o_totalprice") - F.col("before"), 4).alias("change"), "following")


@query("b20_cum_sum", f"SELECT o_orderkey, {MONEY.format('o_totalprice')[:-11]} OVER w AS DOUBLE) AS total, max(o_totalprice) OVER w AS most, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def b20(t: Tables) -> DataFrame:
    parts = Parts(t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    run = parts.running(total=("sum", F.col("o_totalprice").cast("decimal(18,2)")), most=("max", F.col("o_totalprice")), n=("sum", F.lit(1).cast("long")))
    return run.select("o_orderkey", F.col("total").cast("double").alias("total"), "most", "n")


@query(
    "b20_cum_prod",
    "SELECT event_id, pow(2.0, sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 3 - 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS product FROM events",
)
def b20_prod(t: Tables) -> DataFrame:
    """Factors of a half, one and two, some null: their products are exact."""
    factor = F.when(F.col("event_id") % 5 != 0, F.pow(F.lit(2.0), F.col("event_id") % 3 - 1))
    rows = t.events.select("event_id", "user_id", "ts", factor.alias("factor"))
    return frames.cum_prod(rows, "factor", ["user_id"], ["ts", "event_id"], "product").select("event_id", "product")


@query("b21_conditional_agg", f"SELECT l_linestatus, coalesce(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_quantity > 40) AS DOUBLE), 0) AS total FROM lineitem GROUP BY l_linestatus")
def b21(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_linestatus").agg(F.coalesce(money(F.when(F.col("l_quantity") > 40, F.col("l_extendedprice"))), F.lit(0.0)).alias("total"))


@query("b23_rank_over", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)::BIGINT AS place, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS mean_rank FROM part")
def b23(t: Tables) -> DataFrame:
    rows = numbered(t.part.select("p_partkey", "p_brand", "p_retailprice", "p_size"), ["p_retailprice", "p_partkey"], "place", ["p_brand"])
    return frames.average_rank(rows, "p_size", ["p_brand"], "mean_rank").select("p_partkey", (F.col("place") + 1).alias("place"), "mean_rank")


@query("b24_three_aggs", f"SELECT o_orderstatus, {MONEY.format('o_totalprice')} AS total, count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean_val FROM orders GROUP BY o_orderstatus")
def b24(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(money("o_totalprice").alias("total"), F.count("o_totalprice").alias("count"), F.round(F.avg("o_totalprice"), 4).alias("mean_val"))


@query("b09_group_by_day", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def b09(t: Tables) -> DataFrame:
    return temporal.group_by_dynamic(t.events, "ts", [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")], "1d")


@query("b25_sliding_windows", "SELECT window_start, event_type, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts)::TIMESTAMP, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY]) AS window_start, event_type FROM events) GROUP BY ALL")
def b25(t: Tables) -> DataFrame:
    return temporal.group_by_dynamic(t.events, "ts", [F.count("*").alias("n")], "1d", "2d", by=("event_type",)).select("window_start", "event_type", "n")


@query("b26_window_offset", "SELECT date_trunc('day', ts - INTERVAL 12 HOUR)::TIMESTAMP + INTERVAL 12 HOUR AS window_start, count(*) AS n FROM events GROUP BY 1")
def b26(t: Tables) -> DataFrame:
    return temporal.group_by_dynamic(t.events, "ts", [F.count("*").alias("n")], "1d", offset="12h")


@query("b26x_closed_right", "SELECT date_trunc('day', ts - INTERVAL 1 MICROSECOND)::TIMESTAMP AS window_start, count(*) AS n FROM events GROUP BY 1")
def b26x(t: Tables) -> DataFrame:
    return temporal.group_by_dynamic(t.events, "ts", [F.count("*").alias("n")], "1d", closed="right")


@query("b27_rolling", "SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 3) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 172799999999 MICROSECONDS PRECEDING AND CURRENT ROW)")
def b27(t: Tables) -> DataFrame:
    out = temporal.rolling(t.events, "ts", "2d", {"n": F.count("*"), "total": F.sum("value")}, ("user_id",))
    return out.select("event_id", "n", F.round("total", 3).alias("total"))


# ----------------------------------------------------------------------- joins


@query("b10_join_validate", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def b10(t: Tables) -> DataFrame:
    return frames.join(t.customer, t.nation, ["c_nationkey"], ["n_nationkey"], "left", "m:1").select("c_custkey", "n_name")


@query("b29_left_on_right_on", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def b29(t: Tables) -> DataFrame:
    return frames.join(t.customer, t.orders, ["c_custkey"], ["o_custkey"]).select("c_custkey", "o_orderkey")


@query("b30_anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def b30(t: Tables) -> DataFrame:
    return frames.join(t.customer, t.orders, ["c_custkey"], ["o_custkey"], "anti").select("c_custkey", "c_name")


@query("b30x_semi_join", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def b30x(t: Tables) -> DataFrame:
    return frames.join(t.customer, t.orders, ["c_custkey"], ["o_custkey"], "semi").select("c_custkey", "c_name")


_VIEWS = "SELECT user_id, ts, value FROM events WHERE event_type = '{}'"


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    side = lambda kind: t.events.filter(F.col("event_type") == kind)
    return side("purchase").select("event_id", "user_id", "ts"), side("view").select("user_id", "ts", "value").groupBy("user_id", "ts").agg(F.max("value").alias("value"))


_ASOF = "WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) "


@query("b28_asof_backward", _ASOF + "SELECT p.event_id, p.user_id, v.value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts")
def b28(t: Tables) -> DataFrame:
    p, v = _sides(t)
    return temporal.join_asof(p, v, "ts", "user_id", ["value"]).select("event_id", "user_id", "value")


@query("b28x_asof_forward_tolerance", _ASOF + "SELECT p.event_id, CASE WHEN v.ts - p.ts <= INTERVAL 1 DAY THEN v.value END AS value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts <= v.ts")
def b28x(t: Tables) -> DataFrame:
    p, v = _sides(t)
    return temporal.join_asof(p, v, "ts", "user_id", ["value"], "forward", "1d").select("event_id", "value")


@query("b28y_asof_nearest", _ASOF + """, b AS (SELECT p.event_id, v.ts AS bt, v.value AS bv FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts),
  f AS (SELECT p.event_id, p.ts, v.ts AS ft, v.value AS fv FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts <= v.ts)
  SELECT event_id, CASE WHEN ft IS NULL OR (bt IS NOT NULL AND f.ts - bt <= ft - f.ts) THEN bv ELSE fv END AS value FROM b JOIN f USING (event_id)""")
def b28y(t: Tables) -> DataFrame:
    p, v = _sides(t)
    return temporal.join_asof(p, v, "ts", "user_id", ["value"], "nearest").select("event_id", "value")


# --------------------------------------------------------------------- reshape


@query("b39_pivot", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS \"F\", count(*) FILTER (WHERE l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY l_returnflag")
def b39(t: Tables) -> DataFrame:
    counted = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return frames.pivot(counted, "l_returnflag", "l_linestatus", "n", ["F", "O"]).na.fill(0)


@query("b40_unpivot", "SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
def b40(t: Tables) -> DataFrame:
    return t.lineitem.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"], "variable", "value")


@query("b41_explode", "SELECT c_custkey, unnest(string_split(c_mktsegment, 'I')) AS piece FROM customer")
def b41(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.explode_outer(F.split("c_mktsegment", "I", -1)).alias("piece"))


@query("b42_concat_relaxed", "SELECT c_custkey AS key, c_acctbal AS amount FROM customer UNION ALL SELECT s_suppkey, s_nationkey::DOUBLE FROM supplier")
def b42(t: Tables) -> DataFrame:
    a, b = t.customer.selectExpr("c_custkey AS key", "c_acctbal AS amount"), t.supplier.selectExpr("s_suppkey AS key", "s_nationkey AS amount")
    return frames.concat([a, b], "vertical_relaxed")


@query("b46_concat_diagonal", "SELECT c_custkey AS key, c_acctbal AS a, NULL::INT AS b FROM customer UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier")
def b46(t: Tables) -> DataFrame:
    a, b = t.customer.selectExpr("c_custkey AS key", "c_acctbal AS a"), t.supplier.selectExpr("s_suppkey AS key", "s_nationkey AS b")
    return frames.concat([a, b], "diagonal_relaxed")


@query("b43_explain")
def b43(t: Tables) -> DataFrame:
    plan = t.orders.filter("o_totalprice > 1000").select("o_orderkey")
    text = t.spark._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    return t.spark.createDataFrame([(i, x) for i, x in enumerate(text.split("\n"))], "line int, text string")


@query(
    "b43_explain_scan",
    "SELECT * FROM (VALUES ('PushedFilters', '[IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]'), ('ReadSchema', 'struct<o_orderkey:bigint,o_totalprice:double>')) AS t(part, told)",
)
def b43_scan(t: Tables) -> DataFrame:
    """What the plan says of its scan: the filter is pushed down and two columns are read."""
    entry = lambda i: F.regexp_extract("text", r"^(PushedFilters|ReadSchema): (.*)$", i)
    found = b43(t).select(entry(1).alias("part"), entry(2).alias("told"))
    return found.filter("part <> ''")


@query("b44_lazy", "SELECT o_orderkey * 2 AS twice FROM orders")
def b44(t: Tables) -> DataFrame:
    return t.orders.select((F.col("o_orderkey") * 2).alias("twice"))


@query("b45_filter_sum", f"SELECT {MONEY.format('l_extendedprice')} AS total FROM lineitem WHERE l_quantity > 25")
def b45(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_quantity > 25").agg(money("l_extendedprice").alias("total"))


@query("b47_sql", f"SELECT {MONEY.format('o_totalprice')} AS total FROM orders")
def b47(t: Tables) -> DataFrame:
    return t.spark.sql(f"SELECT {MONEY.format('o_totalprice')} AS total FROM {{data}}", data=t.orders)


@query("b50_chain", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, round(sum(value), 4) AS total, count(*) AS n, round(sum(value) / count(*), 4) AS ratio FROM events WHERE value > 0 GROUP BY 1")
def b50(t: Tables) -> DataFrame:
    positive = t.events.filter("value > 0").select(temporal.truncate(F.col("ts"), "1h").alias("hour"), "value")
    out = positive.groupBy("hour").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    return out.select("hour", F.round("s", 4).alias("total"), "n", F.round(F.col("s") / F.col("n"), 4).alias("ratio")).orderBy(F.col("ratio").desc(), "hour")
