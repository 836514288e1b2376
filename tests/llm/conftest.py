import random

import pytest

CLASH = ["id", "key", "node", "sig", "size", "n", "shard", "slot", "bucket", "kept", "count", "token", "_t", "_w", "_spans", "rule", "host", "comp"]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns whose names the operators use inside."""
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(60_000))
    rows = [(1, "one two three four five"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, long), (7, "a"), (7, "a"), (None, "lost words here and there"), (None, None), (8, "x\n" * 500), (9, "é " * 300), (10, "<|endoftext|> y"), (11, "no\u00a0break \u3000 wide"), (12, "A" * 5000)]
    extra = ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(i, t, "en", None, 3, *["z"] * len(CLASH)) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
