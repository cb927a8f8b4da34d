"""Run, version and lineage tables.

A run table has ``run_id, type, name, version, start_time, tags, params,
metrics`` with map columns; datasets and models are runs with a version.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_params(values: Column | str) -> Column:
    """Map values as text."""
    return F.transform_values(values, lambda _, v: v.cast("string"))


def as_metrics(values: Column | str) -> Column:
    """Map values as doubles."""
    return F.transform_values(values, lambda _, v: v.cast("double"))


def find_runs(
    runs: DataFrame, name: str, kind: str, extra_tags: Mapping[str, str] | None = None
) -> DataFrame:
    """Runs of one object, newest first."""
    hit = (F.col("type") == kind) & (F.col("name") == name)
    for key, value in (extra_tags or {}).items():
        hit = hit & (F.col("tags")[key] == value)
    return runs.filter(hit).orderBy(F.desc("start_time"), "run_id")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of every name; the smaller run_id wins a tie.

    An aggregate, so a name with many runs is combined before the shuffle.
    """
    rest = [c for c in runs.columns if c != "name"]
    newest_first = F.struct((-F.unix_micros(F.col("start_time").cast("timestamp"))).alias("t"), F.col("run_id"))
    best = F.min_by(F.struct(*rest), newest_first).alias("_r")
    return runs.groupBy("name").agg(best).select("name", "_r.*")


def map_keys_of(runs: DataFrame, column: str) -> list[str]:
    """Keys of a map column; each becomes a column, so they are read to the driver."""
    rows = runs.select(F.explode(F.map_keys(column)).alias("k")).distinct().collect()
    return sorted(r["k"] for r in rows)


def wide_runs(runs: DataFrame, maps: Sequence[str] = ("tags", "params", "metrics")) -> DataFrame:
    """One column ``<map>.<key>`` per key: a projection, no pivot."""
    cols = [F.col(c) for c in runs.columns if c not in maps]
    for column in maps:
        if column in runs.columns:
            cols += [F.col(column)[k].alias(f"{column}.{k}") for k in map_keys_of(runs, column)]
    return runs.select(*cols)


def max_versions(versions: DataFrame) -> DataFrame:
    return versions.groupBy("name").agg(F.max("version").alias("version"))


def lineage(model_versions: DataFrame, runs: DataFrame, version: int | None = None) -> DataFrame:
    """Model versions (the latest of each name, or one number) with their run's params."""
    if version is not None:
        wanted = model_versions.filter(F.col("version") == version)
    else:
        wanted = model_versions.groupBy("name").agg(
            F.max_by("run_id", "version").alias("run_id"), F.max("version").alias("version")
        )
    return wanted.select("name", "version", "run_id").join(runs.select("run_id", "params"), "run_id")
