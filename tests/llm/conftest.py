import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, shard int, hash string, mix_size long, cell long, row string"


def make_rows():
    """Copies, near copies, shared passages, one very long text, ties, nulls, and columns that clash."""
    g = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(g.choice(vocab) for _ in range(n))
    texts = [prose(g.randint(5, 120)) for _ in range(60)]
    passage = prose(70)
    texts += [f"{prose(20)} {passage} {prose(20)}" for _ in range(10)]
    family = prose(90).split()
    for _ in range(12):
        copy = list(family)
        copy[g.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    texts += [texts[0]] * 4 + ["", "   \n", "one", "two words", "ONE", prose(20_000), "é" * 300, "a" * 700]
    rows = [(i, t, "en", ["src0", "src1", None][i % 3], len(t), i, 1, "h", 5, 2, "r") for i, t in enumerate(texts)]
    return [*rows, (len(rows), None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
