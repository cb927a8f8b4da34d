"""Version, run and lineage queries; orders serve as runs, line items as versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as run_ops
from ..streaming import events as ev
from . import views
from .catalog import ORACLES, query
from .event_queries import label_events

_RUNS = """WITH runs AS (
  SELECT o_orderkey AS run_id, 'run' AS type, lower(replace(o_orderpriority, ' ', '-')) AS name,
    o_orderdate AS start_time, o_orderstatus AS status, o_custkey AS custkey, o_totalprice AS total FROM orders)
"""


def runs(spark, d):
    return views.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.lit("run").alias("type"),
        F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit("-"))).alias("name"),
        F.col("o_orderdate").alias("start_time"),
        F.create_map(F.lit("status"), "o_orderstatus").alias("tags"),
        run_ops.as_params(F.create_map(F.lit("custkey"), "o_custkey")).alias("params"),
        run_ops.as_metrics(F.create_map(F.lit("total"), "o_totalprice")).alias("metrics"),
    )


def versions(spark, d):
    return views.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("name"),
        F.col("l_linenumber").alias("version"),
        F.col("l_orderkey").alias("run_id"),
    )


@query(
    "runs_wide",
    _RUNS
    + """SELECT run_id, type, name, strftime(start_time, '%Y-%m-%d') AS start_day, status AS "tags.status",
  custkey::VARCHAR AS "params.custkey", total AS "metrics.total" FROM runs""",
)
def runs_wide(spark, d):
    wide = run_ops.wide_runs(runs(spark, d))
    return wide.withColumn("start_day", F.date_format("start_time", "yyyy-MM-dd")).drop("start_time")


@query(
    "latest_run",
    _RUNS
    + """SELECT name, run_id, strftime(start_time, '%Y-%m-%d') AS start_day, total FROM runs
QUALIFY row_number() OVER (PARTITION BY name ORDER BY start_time DESC, run_id) = 1""",
)
def latest_run(spark, d):
    flat = runs(spark, d).select(
        "run_id", "name", "start_time", F.col("metrics")["total"].alias("total")
    )
    return run_ops.latest_runs(flat).select(
        "name", "run_id", F.date_format("start_time", "yyyy-MM-dd").alias("start_day"), "total"
    )


@query(
    "find_runs",
    _RUNS + "SELECT run_id, name, custkey::VARCHAR AS custkey FROM runs WHERE name = '2-high' AND status = 'O'",
)
def find_runs(spark, d):
    hit = run_ops.find_runs(runs(spark, d), "2-high", "run", {"status": "O"})
    return hit.select("run_id", "name", F.col("params")["custkey"].alias("custkey"))


@query(
    "dataset_versions",
    """SELECT l_orderkey AS name, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS versions
FROM lineitem GROUP BY 1""",
)
def dataset_versions(spark, d):
    # line numbers have one digit, so text order is number order
    listed = versions(spark, d).groupBy("name").agg(
        F.array_sort(F.collect_set(F.col("version").cast("string"))).alias("v")
    )
    return listed.select("name", F.array_join("v", ",").alias("versions"))


@query(
    "model_max_version",
    "SELECT l_orderkey AS name, max(l_linenumber) AS version FROM lineitem GROUP BY 1",
)
def model_max_version(spark, d):
    return run_ops.max_versions(versions(spark, d))


@query(
    "lineage",
    """SELECT l_orderkey AS name, max(l_linenumber) AS version, o_custkey::VARCHAR AS custkey
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_custkey""",
)
def lineage(spark, d):
    found = run_ops.lineage(versions(spark, d), runs(spark, d))
    return found.select("name", "version", F.col("params")["custkey"].alias("custkey"))


@query(
    "round_history",
    ORACLES["retrain_rounds"].replace("SELECT seq, row_id, labelled_total, round,", ", per_event AS (SELECT seq, labelled_total, round,")
    + """) SELECT round, min(seq) AS first_seq, count(*) AS n_events, arg_min(labelled_total, seq) AS labeled_total
FROM per_event GROUP BY round""",
)
def round_history(spark, d):
    """One row per training round with its first event and the labelled total there."""
    per_event = ev.retrain_rounds(label_events(spark, d), every=10)
    return per_event.groupBy("round").agg(
        F.min("seq").alias("first_seq"),
        F.count(F.lit(1)).alias("n_events"),
        F.min_by("labelled_total", "seq").alias("labeled_total"),
    )
