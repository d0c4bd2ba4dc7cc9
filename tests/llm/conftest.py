import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
WORDS = [a + b for a in ("ther", "ing", "ston", "wal", "rem", "od") for b in ("a", "en", "is", "or", "um", "el", "ith", "and")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Prose with exact and near copies, a shared passage, and every awkward case."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 200)) for _ in range(40)]
    passage = prose(rng, 90)
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[0], "en", "src0", len(base[0])) for i in range(5)]
    rows += [(200 + i, base[1] + " tail" + str(i), "en", "src0", 0) for i in range(5)]
    rows += [(300 + i, f"{prose(rng, 20)} {passage} {prose(rng, 20)}", "en", "src1", 0) for i in range(4)]
    rows += [(400, None, "en", "src0", None), (401, "", None, None, 0), (None, base[2], "en", "src0", 1), (402, "a", "fr", "src2", 1), (402, "a", "fr", "src2", 1), (403, "x" * 5000, "en", "src1", 5000), (404, "ab cd " * 900, "en", "src1", 5400)]
    rows += [(405, "Größe ñandú — ça va? <|endoftext|> 日本 \n\n  end  ", "de", "src1", 9), (406, "one  two   three \t four\n", "en", "src1", 5)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(40)] + [(None, 1, 0), (41, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
