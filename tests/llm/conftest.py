import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _h string, key string, host string, items string, covered string, shard string"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Clean, repeated, junk, short, empty, blank and very long texts, with exact and near copies and a shared passage."""
    rng = random.Random(5)
    clean = ["\n".join(words(rng, 12).capitalize() + "." for _ in range(rng.randrange(3, 9))) for _ in range(40)]
    passage = words(rng, 25)
    near = clean[0].replace("w1", "W1", 1) + " end"
    junk = ["THE!! BEST!! OFFER!! NOW!! " * 20, "aa aa aa aa bb bb bb bb cc cc cc cc " * 9, "x$$$ y### z%%% q&&& " * 15]
    shared = [words(rng, 30) + "\n" + passage + "\n" + words(rng, 30) for _ in range(6)]
    odd = ["", " \t\n ", "one", "a b c", "Éa 漢字 😀 " * 30, "ab" * 400, "z" * 300, words(rng, 20_000)]
    return clean + clean[:5] + [near] + junk + shared + odd


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i * 3, t, "en", f"src{i % 2}", len(t)) for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None), (None, None, "en", "src0", 0), (9_007_199_254_740_993, texts[1], "en", "src1", 3), (6, texts[2], "en", "src0", 1), (6, texts[2], "en", "src0", 1)]
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
