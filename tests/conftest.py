import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from triagekit.session import local_session

    session = local_session("tests")
    yield session
    session.stop()


@pytest.fixture()
def conf(spark):
    """Set tuning knobs for one test."""
    keys = []

    def put(key, value):
        keys.append(key)
        spark.conf.set(key, str(value))

    yield put
    for key in keys:
        spark.conf.unset(key)


@pytest.fixture(scope="session")
def sf():
    return SF


WORDS = {
    "card": "card lost stolen replace plastic pin blocked".split(),
    "loan": "loan rate interest credit borrow monthly term".split(),
    "login": "login password reset account locked email code".split(),
}


@pytest.fixture(scope="session")
def small(spark):
    """Ninety short texts in three classes, some of them ambiguous."""
    import random

    rnd = random.Random(7)
    rows = []
    for i in range(90):
        label = sorted(WORDS)[i % 3]
        words = rnd.choices(WORDS[label], k=4) + rnd.choices(sum(WORDS.values(), []), k=4)
        rows.append((i, " ".join(words), label))
    return spark.createDataFrame(rows, "doc_id long, ticket_text string, category string").repartition(3, "doc_id").cache()
