"""Encoders, scorers and generators brought by the user, run in Arrow batches.

Each surface takes a factory: it is called once per Python worker, so a model is
loaded there and never shipped with the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.labels import label_text
from ..functions.vectors import sigmoid
from .scoring import LabelSide, taxonomy_frame, wide_columns, category_columns

Encoder = Callable[[Sequence[str]], np.ndarray]
Scorer = Callable[[Sequence[str]], Sequence[float]]
Generator = Callable[[Sequence[str]], Sequence[str]]


def encoder_column(
    text: Column | str,
    make_encoder: Callable[[], Encoder],
    batch_size: int = 64,
    normalize: bool = True,
) -> Column:
    """Vector of a text; NULL text gives a NULL vector."""

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            have = texts.dropna()
            place, found = np.flatnonzero(texts.notna().to_numpy()), np.empty(len(texts), object)
            for at in range(0, len(have), batch_size):
                part = have.iloc[at : at + batch_size]
                vectors = np.asarray(encoder(part.tolist()), dtype=np.float64)
                if normalize:
                    vectors = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-12)
                found[place[at : at + len(part)]] = list(vectors.astype(np.float32))
            yield pd.Series(found, index=texts.index)

    return F.pandas_udf(encode, "array<float>")(text)


def encode_texts(
    df: DataFrame,
    make_encoder: Callable[[], Encoder],
    text: str = "text",
    out: str = "vector",
    batch_size: int = 64,
    normalize: bool = True,
) -> DataFrame:
    return df.withColumn(out, encoder_column(F.col(text), make_encoder, batch_size, normalize))


def as_text_frame(spark: SparkSession, texts) -> DataFrame:
    """``row_id, text`` from a table, a pandas Series or a list of texts.

    Lists and Series are for ad-hoc texts; tables keep their own columns.
    """
    if isinstance(texts, DataFrame):
        return texts
    rows = [(i, None if t is None else str(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "row_id bigint, text string")


def embed_labels(
    spark: SparkSession,
    taxonomy: Mapping[str, Mapping[str, str]],
    make_encoder: Callable[[], Encoder],
    bare_names: bool = False,
) -> LabelSide:
    """Label side whose vectors are the embedded ``label. description`` texts."""
    flat = taxonomy_frame(spark, taxonomy)
    words = F.col("label") if bare_names else label_text("label", "description")
    vectors = encode_texts(flat.withColumn("_t", words), make_encoder, "_t", "vector_label")
    return LabelSide.from_frame(vectors)


def score_prompts(
    df: DataFrame, make_scorer: Callable[[], Scorer], prompt: str = "prompt", batch_size: int = 8
) -> DataFrame:
    """Add ``logit`` and ``score`` (its sigmoid) of every prompt."""
    schema = StructType([*df.schema.fields, StructField("logit", DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for rows in batches:
            logits: list[float] = []
            prompts = rows[prompt].tolist()
            for at in range(0, len(prompts), batch_size):
                logits.extend(float(x) for x in scorer(prompts[at : at + batch_size]))
            yield rows.assign(logit=logits)

    return df.mapInPandas(run, schema).withColumn("score", sigmoid("logit"))


def generate_answers(
    df: DataFrame, make_generator: Callable[[], Generator], prompt: str = "prompt", batch_size: int = 8
) -> DataFrame:
    """Add ``generated``; a failing batch is retried row by row and errors are kept."""
    schema = StructType(
        [*df.schema.fields, StructField("generated", StringType()), StructField("error", StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = make_generator()

        def one(text: str) -> tuple[str | None, str | None]:
            try:
                return list(generator([text]))[0], None
            except Exception as failure:
                return None, f"{type(failure).__name__}: {failure}"

        for rows in batches:
            answers: list[tuple[str | None, str | None]] = []
            prompts = rows[prompt].tolist()
            for at in range(0, len(prompts), batch_size):
                part = prompts[at : at + batch_size]
                try:
                    answers.extend((a, None) for a in list(generator(part)))
                except Exception:
                    answers.extend(one(text) for text in part)
            yield rows.assign(
                generated=[a for a, _ in answers], error=[e for _, e in answers]
            )

    return df.mapInPandas(run, schema)


def predict(
    texts,
    model,
    threshold: float | None = None,
    keep: Sequence[str] | None = None,
    categories: bool = False,
    vector: str = "vector",
    make_encoder: Callable[[], Encoder] | None = None,
    text: str = "text",
    spark: SparkSession | None = None,
) -> DataFrame:
    """Wide prediction frame of any model with ``side``, ``threshold`` and ``score_rows``.

    ``texts`` is a table, or a list or a pandas Series of texts, whose places become
    ``row_id``. With ``make_encoder`` the column ``text`` is encoded; without it the table
    has to bring the vectors. Lists keep ``row_id`` and ``text`` unless told otherwise.

    The threshold given here wins over the model's own. Works on streams with
    models that score row by row.
    """
    if isinstance(texts, DataFrame):
        df, keep = texts, keep or ()
    else:
        if make_encoder is None:
            raise ValueError("a list of texts needs an encoder")
        df = as_text_frame(spark or SparkSession.active(), texts)
        keep = ("row_id", "text") if keep is None else keep
    if make_encoder is not None:
        df = encode_texts(df, make_encoder, text, vector)
    thr = model.threshold if threshold is None else float(threshold)
    scored = model.score_rows(df, vector=vector)
    cols = wide_columns(model.side, thr)
    if categories:
        cols += category_columns(model.side, thr)
    return scored.select(*keep, *cols)
