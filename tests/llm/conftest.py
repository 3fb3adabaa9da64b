import random

import pytest

WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi ömicron pi rho sigma tau upsilon".split()


def text_of(rng: random.Random, n: int, words=WORDS) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture
def make(spark):
    """A documents table of (doc_id, text) or (doc_id, text, lang, source, n_chars)."""

    def build(rows, **extra):
        full = []
        for r in rows:
            r = tuple(r)
            full.append(r if len(r) == 5 else (*r, "en", "s", None if r[1] is None else len(r[1])))
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return df.repartition(3) if full else df

    return build


@pytest.fixture
def rng():
    return random.Random(5)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
