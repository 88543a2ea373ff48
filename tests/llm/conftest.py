import random

import pytest

LICENCE = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in it without restriction"


def corpus() -> list[tuple]:
    """Documents with copies, near copies, shared passages, private values, and odd texts."""
    rng = random.Random(7)
    syllables = {"en": "th er on an re he in ed nd ha".split(), "fr": "é le eau aux oi vi qu en tion".split()}

    def words(n: int, lang: str) -> list[str]:
        return ["".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]

    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        w = words(rng.randint(5, 160), lang)
        if i % 5 == 0:
            w[len(w) // 2 : len(w) // 2] = LICENCE.split()
        if i % 7 == 0:
            w += w[: len(w) // 2]
        rows.append([i, " ".join(w), lang])
    for i in range(60, 75):  # near copies of longer texts
        w = rows[i - 60][1].split()
        if len(w) > 80:
            w[i % len(w)] = "changed"
        rows.append([i, " ".join(w), rows[i - 60][2]])
    rows.append([75, rows[3][1], "fr"])
    rows.append([76, rows[3][1].upper(), None])
    rows.append([77, None, "en"])
    rows.append([78, "", "en"])
    rows.append([79, " \n\t ", "fr"])
    rows.append([80, "12 34 --", "en"])
    rows.append([81, "ab cd\nab cd\nab cd\n\n# $ | é漢字 😀", None])
    rows.append([82, "x" * 5000 + " " + "long " * 3000, None])
    rows.append([None, rows[3][1], "fr"])
    rows.append([83, None, None])
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def crowded(spark, rows):
    """Repeated rows, and other columns whose names the operators use themselves."""
    own = [(*r, "kept", 1, [1]) for r in rows for _ in range(2)]
    return spark.createDataFrame(own, "doc_id long, text string, lang string, kept string, n_words int, spans array<int>")
