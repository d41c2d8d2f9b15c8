import pytest

from ebbtide.llm.stage import prepare

SCHEMA = "doc_id long, text string, source string, __n long, id string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (key, text) pairs or texts, with extra columns whose names clash with inner ones."""
    prepare(spark)

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(k, t, None if k is None else "s%d" % (k % 3), 1, "x") for k, t in rows], SCHEMA)
    return make


@pytest.fixture(scope="session")
def prose():
    """Seeded invented sentences."""
    import random
    rnd = random.Random(5)
    syllables = "ta ro mi ne lu so ka vi do pe ran tel mor gis bun".split()
    words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(400)]
    return lambda n, seed: (lambda r: " ".join(r.choice(words) for _ in range(n)))(random.Random(seed))
