"""Tables from and to files, chosen by extension.

CSV and JSON-array files that span lines cannot be split: one file is one task.
Give large inputs as parquet, JSON lines, or many files in a folder.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions import labels as lab
from ..operators import frames
from . import folders

# quotes are doubled inside a cell, and cells may hold line breaks
CSV_READ = {"header": True, "escape": '"', "multiLine": True}
CSV_WRITE = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def extension(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).suffix.lower()


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """Text columns unless a schema is given; nothing is inferred.

    Where no cell holds a line break, ``multi_line=False`` lets a large file be read by
    many tasks; otherwise a file is read by one.
    """
    reader = spark.read.options(**CSV_READ | {"multiLine": multi_line})
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One JSON array of records, or JSON lines; the first character tells which."""
    first = spark.read.text(path).filter(F.trim("value") != "").first()
    is_array = first is not None and first["value"].lstrip().startswith("[")
    reader = spark.read.option("multiLine", is_array)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_json_lines(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_parquet(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read
    return (reader.schema(schema) if schema is not None else reader).parquet(path)


READERS = {
    ".csv": read_csv,
    ".parquet": read_parquet,
    ".json": read_json,
    ".jsonl": read_json_lines,
}


def read_table(
    spark: SparkSession, path: str, schema: StructType | str | None = None, default: str | None = None
) -> DataFrame:
    """Read by extension; an unknown one is an error unless a default is named."""
    reader = READERS.get(extension(path)) or READERS.get(default or "")
    if reader is None:
        raise ValueError(f"unsupported extension {extension(path)!r}; use {list(READERS)}")
    return reader(spark, path, schema)


def load_extraction(spark: SparkSession, path: str, text: str = "text") -> tuple[DataFrame, list[str]]:
    """A table with a text column and at least one field; CSV for unknown extensions."""
    df = read_table(spark, path, default=".csv")
    return df, frames.extraction_fields(df, text)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write by extension. Arrays become JSON text in CSV; JSON is written as lines.

    The rows may come from the path itself. A frame that was read from it before has
    to be read again, since its files are gone then.
    """
    kind = extension(path)
    if kind == ".csv":
        df = df.select(*[_csv_cell(f) for f in df.schema.fields])
    writers = {
        ".parquet": lambda to, how: df.write.mode(how).parquet(to),
        ".csv": lambda to, how: df.write.mode(how).options(**CSV_WRITE).csv(to),
        ".json": lambda to, how: df.write.mode(how).option("ignoreNullFields", False).json(to),
    }
    write = writers.get(".json" if kind == ".jsonl" else kind)
    if write is None:
        raise ValueError(f"unsupported extension {kind!r}")
    if mode == "overwrite":
        folders.replaced(df.sparkSession, path, lambda to: write(to, "error"))
    else:
        write(path, mode)


def _csv_cell(field: StructField) -> Column:
    cell = F.col(f"`{field.name}`")
    return F.to_json(cell).alias(field.name) if isinstance(field.dataType, ArrayType) else cell


def write_labelled(df: DataFrame, path: str, labels: str = "labels") -> None:
    """Write only the rows that have labels."""
    write_table(frames.labelled_rows(df, labels), path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    write = predictions.select("text", "true", "predicted").write.options(**CSV_WRITE)
    folders.replaced(predictions.sparkSession, path, write.csv)


def write_vocabulary(df: DataFrame, path: str, labels: str = "labels") -> None:
    """Sorted distinct labels as JSON lines."""
    write = frames.vocabulary(df, labels).orderBy("label_key").write
    folders.replaced(df.sparkSession, path, write.json)


def _saved(spark: SparkSession, path: str) -> DataFrame | None:
    folders.mended(spark, path)
    try:
        return read_table(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def resume_or_start(
    spark: SparkSession, df: DataFrame, path: str, text: str = "text", labels: str = "labels"
) -> DataFrame:
    """The saved table when it fits the input, else the input with empty labels."""
    saved = _saved(spark, path)
    if saved is not None and text in saved.columns and saved.count() == df.count():
        df = saved
    return with_label_column(df, labels)


def with_label_column(df: DataFrame, labels: str = "labels") -> DataFrame:
    if labels not in df.columns:
        return df.withColumn(labels, lab.empty_labels())
    if isinstance(df.schema[labels].dataType, ArrayType):
        return df.withColumn(labels, F.coalesce(labels, lab.empty_labels()))
    return df.withColumn(labels, lab.parse_json_list(labels))
