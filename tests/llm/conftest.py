import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, label double, rep string, words string"


def syllables(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "ti", "es", "ha"]) for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(3)
    base = syllables(rng, 120)
    words = base.split()
    texts = [None, "", "   \n\t", "one", "One", base, base, base.upper(), " ".join(words[:-3] + ["x", "y", "z"]), " ".join(words[:60] + ["q"] * 60),
             "héllo wörld ñ 漢字 \U0001F600 it's", syllables(rng, 30000), "x" * 70000, "\n".join([base, "short", base]), "<|endoftext|> mid <|startoftext|>. <|ENDOFTEXT|>, The. THE, it's. l'an, end.. a.b, 12. É. x,",
             "password = \"abcdef123456\"\nAKIA" + "A1B2C3D4" * 3, "Licensed under the Apache License, Version 2.0.\n" + base]
    rows = [(i * 3 + 1, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, None if i % 4 == 0 else 5, i, 0.5, "r", "w") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, "en", "src1", 1, 1, None, None, None), (None, None, None, None, None, None, None, None, None),
             (1, base + " tail", "de", "src0", 1, 1, 0.0, "", "")]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
