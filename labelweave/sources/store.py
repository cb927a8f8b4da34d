"""A registry of what a use case has made: dataset versions, model versions, runs.

Everything is a row of one append-only table, ``Registry``. Data and models lie in a
folder named by their row's id and are written before the row, so a row never points
at something half written, and a folder without a row is never seen. Version numbers
are claimed by creating an empty file, which only one writer can; a writer that dies
after its claim leaves a gap in the numbers and nothing else.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import runs as run_ops
from . import folders

RUN_SCHEMA = (
    "run_id string, type string, name string, version int, start_time timestamp, path string, "
    "signature string, tags map<string,string>, params map<string,string>, metrics map<string,double>"
)
ROUND_SCHEMA = (
    "round int, n_pairs bigint, epochs int, labeled_total bigint, mean_loss double, "
    "macro_f1 double, micro_f1 double"
)
# The tags every row has, and the form of a name.
OWN_TAGS = ("type", "use_case", "name", "version")
SLUG = re.compile(r"[a-z0-9][a-z0-9_-]*")


def check_slug(what: str, value: object) -> str:
    """The value, if it can name a folder: lower case, no double underscore."""
    if isinstance(value, str) and SLUG.fullmatch(value) and "__" not in value:
        return value
    raise ValueError(f"{value!r} is no {what}: {SLUG.pattern}, and no '__'")


def texts(values: Mapping | None) -> dict[str, str]:
    return {k: str(v) for k, v in (values or {}).items()}


@dataclass
class Entry:
    """What a row of the registry says besides its kind, name and number."""

    tags: Mapping | None = None
    params: Mapping | None = None
    metrics: Mapping | None = None
    signature: Mapping | None = None
    path: str | None = None
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)


class Registry:
    """The table of rows of a use case."""

    def __init__(self, spark: SparkSession, base: str, use_case: str) -> None:
        self.spark, self.base, self.use_case = spark, base, use_case

    def table(self, folder: str, schema: str) -> DataFrame:
        """Rows of a folder, none while there is no such folder."""
        folders.mended(self.spark, f"{self.base}/{folder}")
        try:
            return self.spark.read.schema(schema).parquet(f"{self.base}/{folder}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def add(self, folder: str, schema: str, row: tuple) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(
            f"{self.base}/{folder}"
        )

    def compact(self, folder: str, schema: str) -> None:
        """Rewrite a folder of many one-row files as one; nobody else may write meanwhile."""
        rows = self.table(folder, schema).coalesce(1)
        folders.replaced(self.spark, f"{self.base}/{folder}", rows.write.parquet)

    def rows(self) -> DataFrame:
        return self.table("runs", RUN_SCHEMA)

    def record(self, kind: str, name: str, entry: Entry, version: int | None = None) -> str:
        own = dict(zip(OWN_TAGS, (kind, self.use_case, name, version)))
        clash = sorted(set(entry.tags or ()) & set(own))
        if clash:
            raise ValueError(f"{', '.join(clash)}: tags that every row has already")
        tags = texts({k: v for k, v in own.items() if v is not None} | dict(entry.tags or {}))
        metrics = {k: float(v) for k, v in (entry.metrics or {}).items()}
        signature = None if entry.signature is None else json.dumps(entry.signature)
        self.add(
            "runs",
            RUN_SCHEMA,
            (entry.run_id, kind, name, version, datetime.now(timezone.utc), entry.path, signature,
             tags, texts(entry.params), metrics),
        )
        return entry.run_id

    def numbers(self, kind: str, name: str) -> list[int]:
        """Versions of a name, rising."""
        found = run_ops.find_runs(self.rows(), check_slug("name", name), kind)
        return sorted(r["version"] for r in found.select("version").collect())

    def publish(self, kind: str, name: str, entry: Entry, write: Callable[[str], None]) -> int:
        """Write to a folder of its own, claim the next number, record both."""
        check_slug("name", name)
        entry.path = f"{self.base}/{kind}s/{name}/{entry.run_id}"
        write(entry.path)
        number = max(self.numbers(kind, name), default=0) + 1
        while not folders.claim(self.spark, f"{self.base}/claims/{kind}/{name}/{number}"):
            number += 1
        self.record(kind, name, entry, number)
        return number

    def published(self, kind: str, name: str, version: int | None) -> Row:
        """The row of a version, by default of the newest."""
        numbers = self.numbers(kind, name)
        wanted = max(numbers, default=None) if version is None else version
        if wanted not in numbers:
            raise KeyError(f"{self.use_case}: {kind} {name} has {numbers or 'no versions'}, asked for {version}")
        found = run_ops.find_runs(self.rows(), name, kind)
        return found.filter(F.col("version") == wanted).first()


class Store:
    """Rounds, runs, models and datasets of one use case under a root folder."""

    def __init__(self, spark: SparkSession, root: str, use_case: str):
        self.spark = spark
        self.use_case = check_slug("use case", use_case)
        self.base = f"{root.rstrip('/')}/{use_case}"
        self.registry = Registry(spark, self.base, use_case)

    # rounds of training, one row each, written once the scores are known

    def append_round(
        self,
        round_no: int,
        n_pairs: int,
        epochs: int,
        labelled_total: int,
        mean_loss: float | None,
        macro_f1: float | None = None,
        micro_f1: float | None = None,
    ) -> None:
        row = (round_no, n_pairs, epochs, labelled_total, mean_loss, macro_f1, micro_f1)
        self.registry.add("rounds", ROUND_SCHEMA, row)

    def rounds(self) -> DataFrame:
        return self.registry.table("rounds", ROUND_SCHEMA).orderBy("round")

    def next_round(self) -> int:
        return (self.rounds().agg(F.max("round")).first()[0] or 0) + 1

    # runs

    def runs(self) -> DataFrame:
        """All rows of the registry."""
        return self.registry.rows()

    def list_runs(self) -> DataFrame:
        """All rows with one column per tag, param and metric."""
        return run_ops.wide_runs(self.runs())

    def find_runs(
        self, name: str, kind: str, extra_tags: Mapping[str, str] | None = None
    ) -> DataFrame:
        return run_ops.find_runs(self.runs(), name, kind, extra_tags)

    def get_run(self, name: str) -> Row | None:
        """Newest run of a name, or None."""
        return self.find_runs(check_slug("name", name), "run").first()

    def submit_run(
        self,
        name: str,
        params: Mapping | None = None,
        metrics: Mapping | None = None,
        tags: Mapping | None = None,
    ) -> str:
        return self.registry.record("run", check_slug("name", name), Entry(tags, params, metrics))

    def compact(self) -> None:
        """Rewrite the registry's many small files; nobody else may write meanwhile."""
        self.registry.compact("runs", RUN_SCHEMA)

    # models

    def model_run(self, name: str, version: int | None = None) -> Row:
        return self.registry.published("model", name, version)

    def model_run_params(self, name: str, version: int | None = None) -> dict[str, str]:
        return self.model_run(name, version)["params"]

    def latest_model_version(self, name: str) -> int:
        return self.model_run(name)["version"]

    def get_model(self, name: str, version: int | None = None, loader: Callable | None = None):
        """A model of any kind that ``submit_model`` takes."""
        from ..operators import model_files

        path = self.model_run(name, version)["path"]
        return loader(path) if loader else model_files.load_model(self.spark, path)

    def submit_model(
        self,
        model,
        name: str,
        base_model: str | None = None,
        base_version: int | None = None,
        params: Mapping | None = None,
        metrics: Mapping | None = None,
        signature: Mapping | None = None,
        tags: Mapping | None = None,
        predictions: Mapping[str, DataFrame] | None = None,
    ) -> int:
        """Save a model and register it with the model it builds on.

        ``predictions`` are tables by split, kept in the model's folder.
        """
        from ..operators import model_files

        built_on = {}
        if base_model is not None:
            built_on = {"base_model": base_model, "base_version": "" if base_version is None else base_version}
        entry = Entry(tags, built_on | dict(params or {}), metrics, signature)

        def write(path: str) -> None:
            model_files.save_model(self.spark, model, path)
            for split, rows in (predictions or {}).items():
                rows.write.parquet(f"{path}/predictions/{split}")

        return self.registry.publish("model", name, entry, write)

    def get_predictions(self, name: str, split: str, version: int | None = None) -> DataFrame:
        """A table of predictions that was submitted with a model."""
        return self.spark.read.parquet(f"{self.model_run(name, version)['path']}/predictions/{split}")

    # datasets

    def get_dataset(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.registry.published("dataset", name, version)["path"])

    def list_dataset_versions(self, name: str) -> list[int]:
        return self.registry.numbers("dataset", name)

    def submit_dataset(self, df: DataFrame, name: str, tags: Mapping | None = None) -> int:
        """Write a table as the next version of a name."""
        if not isinstance(df, DataFrame):
            raise TypeError(f"a Spark DataFrame is needed, not {type(df).__name__}")
        clash = sorted(set(tags or ()) & set(OWN_TAGS))
        if clash:
            raise ValueError(f"{', '.join(clash)}: tags that every row has already")
        return self.registry.publish("dataset", name, Entry(tags), df.write.parquet)
