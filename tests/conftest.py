import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks.compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def series_of(spark):
    """Series table of a dict ``id -> values``."""

    def make(values, partitions=3):
        rows = [(int(i), [float(x) for x in v]) for i, v in values.items()]
        return spark.createDataFrame(rows, "id BIGINT, v ARRAY<DOUBLE>").repartition(partitions)

    return make


@pytest.fixture(scope="session")
def queries_of(spark):
    """Packed queries of a dict ``qid -> (positions, values)``."""

    def make(queries):
        rows = [(int(i), [int(p) for p in pos], [float(x) for x in q]) for i, (pos, q) in queries.items()]
        return spark.createDataFrame(rows, "qid BIGINT, pos ARRAY<INT>, q ARRAY<DOUBLE>")

    return make
