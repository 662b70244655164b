import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from netwarden.session import build_session
    yield build_session(master="local[*]", shuffle_partitions=4)


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text) pairs, with the other columns and a clashing extra one."""
    def make(rows, sources=None, parts=3):
        full = [(i, t, "en", (sources or {}).get(i, "s"), None if t is None else len(t), "x")
                for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, name string").repartition(parts)
    return make
