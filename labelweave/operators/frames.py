"""Table checks, label tables and review frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as lab


def require_labelled(df: DataFrame, text: str = "text", labels: str = "labels") -> DataFrame:
    missing = [c for c in (text, labels) if c not in df.columns]
    if missing:
        raise ValueError(f"dataset needs {text!r} and {labels!r} columns; missing {missing}")
    return df


def extraction_fields(df: DataFrame, text: str = "text") -> list[str]:
    """Every column besides the text column; at least one is needed."""
    if text not in df.columns:
        raise ValueError(f"no column {text!r}; columns are {df.columns}")
    fields = [c for c in df.columns if c != text]
    if not fields:
        raise ValueError("no target columns besides the text column")
    return fields


def stacked(df: DataFrame, names: Sequence[str], rows: Sequence[Sequence[Column]]) -> DataFrame:
    """Turn every input row into several output rows with the given columns."""
    structs = [F.struct(*[c.alias(n) for n, c in zip(names, row)]) for row in rows]
    return df.select(F.inline(F.array(*structs)))


def is_labelled(labels: str = "labels") -> Column:
    """True for rows with at least one label; NULL labels are no labels."""
    return F.coalesce(F.size(labels) > 0, F.lit(False))


def labelled_rows(df: DataFrame, labels: str = "labels") -> DataFrame:
    return df.filter(is_labelled(labels))


def unlabelled_rows(df: DataFrame, labels: str = "labels") -> DataFrame:
    return df.filter(~is_labelled(labels))


def vocabulary(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Distinct labels of all rows."""
    return df.select(F.explode(labels).alias("label_key")).distinct()


def fit_classes(df: DataFrame, labels: str = "labels") -> list[str]:
    """Sorted vocabulary, as the list of a model's classes."""
    return sorted(r[0] for r in vocabulary(df, labels).collect())


def encode(df: DataFrame, classes: Sequence[str], labels: str = "labels") -> DataFrame:
    return df.withColumn("multi_hot", lab.multi_hot(labels, classes))


def encode_train_test(
    train: DataFrame, test: DataFrame, labels: str = "labels"
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Parse labels, fit the classes on train and encode both tables."""
    train, test = (with_parsed_labels(require_labelled(d, labels=labels), labels) for d in (train, test))
    classes = fit_classes(train, labels)
    return encode(train, classes, labels), encode(test, classes, labels), classes


def with_parsed_labels(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Text labels become arrays; arrays are stripped and blanks dropped."""
    kind = dict(df.dtypes)[labels]
    if kind == "string":
        return df.withColumn(labels, lab.parse_any(labels))
    cleaned = F.filter(
        F.transform(F.col(labels).cast("array<string>"), lab.strip),
        lambda x: x.isNotNull() & (x != ""),
    )
    return df.withColumn(labels, F.coalesce(cleaned, lab.empty_labels()))


def one_hot_columns(keys: Sequence[str], labels: str = "labels") -> list[Column]:
    return [lab.has_label(F.col(labels), k).alias(k) for k in keys]


def as_one_hot(df: DataFrame, keys: Sequence[str], labels: str = "labels") -> DataFrame:
    """One boolean column per label key next to the row."""
    return df.select("*", *one_hot_columns(keys, labels))


def predictions_frame(
    df: DataFrame, classes: Sequence[str], truth_hot: str, predicted_hot: str, keep: Sequence[str] = ("text",)
) -> DataFrame:
    """``true`` and ``predicted`` names joined by ``;`` in class order."""
    return df.select(
        *keep,
        F.array_join(lab.decode_multi_hot(truth_hot, classes), ";").alias("true"),
        F.array_join(lab.decode_multi_hot(predicted_hot, classes), ";").alias("predicted"),
    )


def review_frame(
    df: DataFrame, truth: str, predicted: str, keep: Sequence[str] = ("text",)
) -> DataFrame:
    """Sorted true and predicted labels and whether both sets are equal."""
    return df.select(
        *keep,
        F.array_sort(truth).alias("labels"),
        F.array_sort(predicted).alias("predicted"),
        lab.same_set(truth, predicted).alias("is_correct"),
    )


def is_blank(text: str = "text") -> Column:
    return F.col(text).isNull() | F.col(text).rlike(rf"(?U)\A{lab.WHITE_SPACE}*\z")


def validation_report(
    df: DataFrame,
    row_id: str,
    text: str = "text",
    tags: str = "labels",
    blank: Column | None = None,
) -> DataFrame:
    """Violations per rule with their number and the first offending row id.

    ``blank`` is a flag computed ahead, for tables that no longer hold the text.
    """
    blank = is_blank(text) if blank is None else blank
    untagged = F.coalesce(F.size(tags) <= 0, F.lit(True))
    found = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(blank, 1)).alias("n_blank"),
        F.min(F.when(blank, F.col(row_id))).cast("bigint").alias("first_blank"),
        F.count(F.when(untagged, 1)).alias("n_untagged"),
        F.min(F.when(untagged, F.col(row_id))).cast("bigint").alias("first_untagged"),
    )
    too_few = F.when(F.col("n") < 2, 1).otherwise(0).cast("bigint")
    return stacked(
        found,
        ["rule", "violations", "first_row"],
        [
            (F.lit("at_least_two_rows"), too_few, F.lit(None).cast("bigint")),
            (F.lit("non_blank_text"), F.col("n_blank"), F.col("first_blank")),
            (F.lit("at_least_one_tag"), F.col("n_untagged"), F.col("first_untagged")),
        ],
    )


def validate(df: DataFrame, row_id: str, text: str = "text", tags: str = "labels") -> DataFrame:
    """Raise on the first broken rule, else return the table."""
    for rule, count, first in validation_report(df, row_id, text, tags).collect():
        if count:
            raise ValueError(f"{rule}: {count} violation(s), first row {first}")
    return df


def nested_examples(df: DataFrame, text: str, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Text next to one struct of all fields."""
    return df.select(*keep, text, F.struct(*fields).alias("extracted"))


def text_key(text: str = "text") -> Column:
    """Digest that stands for a whole text in joins and groups, so that texts stay put."""
    return F.sha2(F.col(text), 256)


def without_seen(df: DataFrame, seen: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text does not occur in ``seen``."""
    known = seen.select(text_key(text).alias("_key")).distinct()
    return df.withColumn("_key", text_key(text)).join(known, "_key", "left_anti").drop("_key")


def distinct_texts(df: DataFrame, row_id: str, text: str = "text") -> DataFrame:
    """``text_key, row_id``: the smallest row id of every text.

    Only digests and ids are shuffled; equal texts are combined before that.
    """
    return df.groupBy(text_key(text).alias("text_key")).agg(F.min(row_id).alias(row_id))


def aligned(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Put two tables side by side by row id, never by position."""
    return left.join(right, row_id)


def dataset_summary(texts: DataFrame, pairs: DataFrame, labels: str = "labels") -> DataFrame:
    """Row, vocabulary and pair counts as ``item, n`` rows."""
    rows = texts.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("item"), "n")
    vocab = vocabulary(texts, labels).agg(F.count(F.lit(1)).alias("n"))
    by_label = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(vocab.select(F.lit("vocabulary").alias("item"), "n")).unionByName(
        by_label.select(
            F.when(F.col("label") == 1, "positive_pairs").otherwise("negative_pairs").alias("item"),
            "n",
        )
    )
