"""Report analytics: order lines stand for page rows (a supplier's order is a document, a line its page)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.numeric import percent
from weft.operators import reports as R
from weft.plans.registry import query
from weft.sources import read_table
from weft.sources.reports import latest_entries

_ROWS = """(SELECT l_orderkey AS pdf, l_linenumber AS page, l_quantity * 2 AS exact, 100 - l_discount * 100 AS similarity, l_suppkey, l_partkey,
            CAST(l_quantity AS BIGINT) AS matched, CAST(50 AS BIGINT) AS total, l_returnflag = 'R' AS error, l_linestatus AS status FROM lineitem)"""


def _rows(spark, folder):
    line = read_table(spark, folder, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("pdf"), F.col("l_linenumber").alias("page"), (F.col("l_quantity") * 2).alias("exact"), (100 - F.col("l_discount") * 100).alias("similarity"), "l_suppkey", "l_partkey",
        F.col("l_quantity").cast("bigint").alias("matched"), F.lit(50).cast("bigint").alias("total"), (F.col("l_returnflag") == "R").alias("error"), F.col("l_linestatus").alias("status"),
    )


@query(
    "compare_summary",
    f"""SELECT count(DISTINCT pdf) AS documents, count(*) AS rows, count(*) FILTER (exact = 100 AND NOT error) AS exact_pages, count(*) FILTER (error) AS error_rows,
               CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(total) AS BIGINT) AS total, round(100.0 * sum(matched) / sum(total), 6) AS percent FROM {_ROWS}""",
)
def compare_summary(spark, folder):
    out = R.summarize(_rows(spark, folder), "pdf", F.col("exact") == 100, F.col("error"), F.col("matched"), F.col("total"))
    return out.withColumn("percent", F.round("percent", 6))


@query("pass_rate", f"SELECT status, count(*) AS pages, count(*) FILTER (similarity >= 95) AS passed, round(100.0 * count(*) FILTER (similarity >= 95) / count(*), 6) AS rate FROM {_ROWS} GROUP BY status")
def pass_rate(spark, folder):
    return R.pass_rates(_rows(spark, folder), ["status"], F.col("similarity") >= 95).withColumn("rate", F.round("rate", 6))


@query("worst_pages_topk", f"SELECT pdf, page, round(similarity, 4) AS similarity, exact FROM {_ROWS} ORDER BY round(similarity, 4), exact, pdf, CAST(page AS VARCHAR) LIMIT 25")
def worst_pages_topk(spark, folder):
    rows = _rows(spark, folder).select("pdf", "page", F.round("similarity", 4).alias("similarity"), "exact")
    return rows.orderBy("similarity", "exact", "pdf", F.col("page").cast("string")).limit(25)


@query(
    "doc_avg_worst_page",
    f"""SELECT pdf, round(coalesce(avg(s) FILTER (NOT error), 0), 4) AS mean, coalesce(min(s) FILTER (NOT error), -1) AS least,
               CAST(coalesce(arg_min(page, s * 100 + page) FILTER (NOT error), -1) AS INTEGER) AS worst_page, count(*) FILTER (error) AS errors, bool_and(s >= 92 AND NOT error) AS all_pass
        FROM (SELECT *, round(similarity, 4) AS s FROM {_ROWS}) GROUP BY pdf""",
)
def doc_avg_worst_page(spark, folder):
    rows = _rows(spark, folder).withColumn("s", F.round("similarity", 4))
    out = R.worst_per_document(rows, "pdf", "page", "s", F.col("s") >= 92, F.col("error"))
    return out.withColumns({"mean": F.round("mean", 4), "least": F.coalesce("least", F.lit(-1.0)), "worst_page": F.coalesce("worst_page", F.lit(-1))})


@query("worst_docs_min", f"SELECT l_suppkey, least(101.0, min(exact)) AS least FROM {_ROWS} WHERE NOT error GROUP BY l_suppkey ORDER BY least, l_suppkey LIMIT 10")
def worst_docs_min(spark, folder):
    return _rows(spark, folder).where(~F.col("error")).groupBy("l_suppkey").agg(F.least(F.lit(101.0), F.min("exact")).alias("least")).orderBy("least", "l_suppkey").limit(10)


@query("failure_type_counts", "SELECT coalesce(nullif(trim(CASE WHEN event_id % 4 = 0 THEN '  ' ELSE event_type END), ''), 'unknown') AS kind, count(*) AS n FROM events GROUP BY 1")
def failure_type_counts(spark, folder):
    return R.count_by(read_table(spark, folder, "events"), F.when(F.col("event_id") % 4 == 0, F.lit("  ")).otherwise(F.col("event_type")), "kind")


@query("top_fail_docs", "SELECT user_id, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY user_id ORDER BY n DESC, first_seen LIMIT 15")
def top_fail_docs(spark, folder):
    return read_table(spark, folder, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(15)


_METRICS = {"rows": "count(*)", "value": "round(avg(o_totalprice), 2)", "open": "round(100.0 * count(*) FILTER (o_orderstatus = 'O') / count(*), 4)"}


def _delta_sql(columns: str) -> str:
    side = lambda s, keep: f"(SELECT {', '.join(f'CAST({m} AS DOUBLE) AS {n}_{s}' for n, m in _METRICS.items())} FROM orders WHERE o_orderkey % 2 = {keep})"
    deltas = ", ".join(f"round({n}_after - {n}_before, 4) AS {n}_delta" for n in _METRICS)
    return f"SELECT {columns} FROM (SELECT *, {deltas}, " + " OR ".join(f"round({n}_after - {n}_before, 4) < 0" for n in _METRICS) + f" AS regression FROM {side('before', 0)}, {side('after', 1)})"


def _delta(spark, folder):
    orders = read_table(spark, folder, "orders")
    metrics = {"rows": F.count(F.lit(1)).cast("double"), "value": F.round(F.avg("o_totalprice"), 2), "open": F.round(percent(F.count_if(F.col("o_orderstatus") == "O"), F.count(F.lit(1))), 4)}
    out = R.report_delta(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1"), metrics)
    return out.withColumns({f"{n}_delta": F.round(f"{n}_delta", 4) for n in metrics})


@query("report_diff", _delta_sql("* EXCLUDE (regression)"))
def report_diff(spark, folder):
    return _delta(spark, folder).drop("regression")


@query("regression_gate", _delta_sql("regression"))
def regression_gate(spark, folder):
    return _delta(spark, folder).select("regression")


_LEFT = "SELECT DISTINCT c_nationkey AS pdf, c_custkey % 23 + 1 AS page FROM customer WHERE c_mktsegment = 'BUILDING'"
_RIGHT = "SELECT DISTINCT c_nationkey AS pdf, c_custkey % 23 + 1 AS page FROM customer WHERE c_mktsegment = 'MACHINERY'"


@query(
    "page_spine_join",
    f"""WITH l AS ({_LEFT}), r AS ({_RIGHT}), m AS (SELECT pdf, max(page) AS last FROM (SELECT * FROM l UNION ALL SELECT * FROM r) GROUP BY pdf),
             s AS (SELECT pdf, unnest(generate_series(1, last)) AS page FROM m)
        SELECT s.pdf, s.page, CASE WHEN l.page IS NULL AND r.page IS NULL THEN 'both missing' WHEN l.page IS NULL THEN 'left missing' WHEN r.page IS NULL THEN 'right missing' ELSE 'ok' END AS status
        FROM s LEFT JOIN l ON s.pdf = l.pdf AND s.page = l.page LEFT JOIN r ON s.pdf = r.pdf AND s.page = r.page""",
)
def page_spine_join(spark, folder):
    pages = read_table(spark, folder, "customer").select(F.col("c_nationkey").alias("pdf"), (F.col("c_custkey") % 23 + 1).alias("page"), "c_mktsegment")
    return R.page_spine(pages.where("c_mktsegment = 'BUILDING'"), pages.where("c_mktsegment = 'MACHINERY'"), "pdf", "page")


@query(
    "positional_zip",
    """SELECT s.i, s_suppkey, p_partkey FROM (SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_suppkey) AS INTEGER) AS i FROM supplier) s
       JOIN (SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey DESC) AS INTEGER) AS i FROM part) p ON s.i = p.i WHERE s.i <= 50""",
)
def positional_zip(spark, folder):
    from pyspark.sql import Window

    def first(df, order, key):
        return df.orderBy(order).limit(50).select(key, F.row_number().over(Window.orderBy(order)).alias("i"))  # fifty rows

    return first(read_table(spark, folder, "supplier"), F.col("s_suppkey"), "s_suppkey").join(first(read_table(spark, folder, "part"), F.desc("p_partkey"), "p_partkey"), "i")


@query(
    "floor_gate",
    """WITH f AS (SELECT n_nationkey, n_name, n_nationkey * 300.0 AS floor FROM nation WHERE n_nationkey % 4 <> 0)
       SELECT s_suppkey, n_name, round(s_acctbal - floor, 4) AS delta, s_acctbal >= floor AS passed FROM supplier JOIN f ON s_nationkey = n_nationkey""",
)
def floor_gate(spark, folder):
    floors = read_table(spark, folder, "nation").where("n_nationkey % 4 <> 0").select("n_nationkey", "n_name", (F.col("n_nationkey") * 300.0).alias("floor"))
    joined = read_table(spark, folder, "supplier").join(floors, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("s_suppkey", "n_name", F.round(F.col("s_acctbal") - F.col("floor"), 4).alias("delta"), (F.col("s_acctbal") >= F.col("floor")).alias("passed"))


@query(
    "dest_resolve",
    """SELECT c_custkey, coalesce(i, -1) AS page_index FROM customer LEFT JOIN
       (SELECT n_regionkey AS ref, max(n_nationkey) AS i FROM nation GROUP BY n_regionkey) ON c_nationkey % 7 = ref""",
)
def dest_resolve(spark, folder):
    """A page listed twice keeps its last index; an unknown reference is -1."""
    pages = read_table(spark, folder, "nation").groupBy(F.col("n_regionkey").alias("ref")).agg(F.max("n_nationkey").alias("i"))
    joined = read_table(spark, folder, "customer").join(pages, F.col("c_nationkey") % 7 == F.col("ref"), "left")
    return joined.select("c_custkey", F.coalesce("i", F.lit(-1)).alias("page_index"))


@query("xref_latest_wins", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def xref_latest_wins(spark, folder):
    return latest_entries(read_table(spark, folder, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("first_match_lookup", "SELECT user_id, coalesce(min(event_id) FILTER (event_type = 'purchase'), -1) AS first_index FROM events GROUP BY user_id")
def first_match_lookup(spark, folder):
    return read_table(spark, folder, "events").groupBy("user_id").agg(F.coalesce(F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))), F.lit(-1)).alias("first_index"))


@query("compare_csv_lines", f"SELECT concat(pdf, ',', page, ',', printf('%.8f', exact), ',', CASE WHEN error THEN 'error' ELSE '' END) AS line FROM {_ROWS}")
def compare_csv_lines(spark, folder):
    return _rows(spark, folder).select(F.format_string("%d,%d,%.8f,%s", "pdf", "page", "exact", F.when(F.col("error"), F.lit("error")).otherwise(F.lit(""))).alias("line"))


@query("error_and_page_rows", f"SELECT pdf, 0 AS page, 'error' AS kind FROM {_ROWS} WHERE error GROUP BY pdf UNION ALL SELECT pdf, page, 'page' FROM {_ROWS} WHERE NOT error")
def error_and_page_rows(spark, folder):
    rows = _rows(spark, folder)
    errors = rows.where("error").select("pdf").distinct().select("pdf", F.lit(0).alias("page"), F.lit("error").alias("kind"))
    return errors.unionByName(rows.where("NOT error").select("pdf", "page", F.lit("page").alias("kind")))


@query("slowest_guard", "SELECT event_type, round(avg(value), 4) AS avg_ms, max(value) AS slowest_ms, round(avg(value), 4) <= 80 AND max(value) <= 200 AS passed FROM events GROUP BY event_type")
def slowest_guard(spark, folder):
    out = read_table(spark, folder, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("avg_ms"), F.max("value").alias("slowest_ms"))
    return out.withColumn("passed", (F.col("avg_ms") <= 80) & (F.col("slowest_ms") <= 200))
