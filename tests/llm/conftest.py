"""A small corpus with the cases that need a defined result, and plain readings of it."""

import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, batch string,"
    " payload long, row string, keep long, _range string, `a.b` int"
)


def corpus() -> list[tuple]:
    rng = random.Random(3)
    vocabulary = [
        "".join(rng.choice(["ba", "do", "ké", "lu", "mi", "xn"]) for _ in range(rng.randint(1, 4)))
        for _ in range(400)
    ]

    def prose(n: int) -> str:
        words = [rng.choice(vocabulary) for _ in range(n)]
        return "".join(w + rng.choice([" "] * 9 + [". ", "\n"]) for w in words).strip()

    shared, lines = prose(70), [prose(12).replace("\n", " ") for _ in range(3)]
    texts = [None, "", "   \n\t ", "one", "日本 x😀", "a a a a " * 40, "SE!! CI!! " * 60, "z" * 900]
    for i in range(40):
        text = prose(rng.randint(3, 220))
        if i % 3 == 0:
            text = f"{text}\n{shared} {prose(5)}"
        if i % 4 == 0:
            text = f"{lines[i % 3]}\n{text}\n{lines[(i + 1) % 3]}"
        texts.append(text)
    texts += [texts[9], texts[9], texts[12] + " tail", texts[15].replace(" ", " new ", 1)]
    texts += [prose(4000)]
    rows = [
        (i * 3, t, rng.choice(["en", "de", None]), f"src{i % 5}" if i % 7 else None, len(t or ""), "b", 1, "r", 2, "x", 3)
        for i, t in enumerate(texts)
    ]
    rows.append(rows[10])  # a repeated row
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
