"""Every oracle-backed query equals its DuckDB SQL on the smallest tables."""
import pytest

import __spark_entry__ as E
from oracle_check import compare, duck

from scales import SF_SMALL

ORACLES = E.oracle_sql()
QUERIES = E.queries()

SLUGS = sorted(ORACLES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan_problems(df):
    import json
    qe = df._jdf.queryExecution()
    text = qe.executedPlan().toString()
    bad = [f for f in FORBIDDEN if f in text]
    plan = qe.executedPlan()
    try:                      # adaptive execution wraps the operators
        plan = plan.initialPlan()
    except Exception:         # noqa: BLE001
        pass
    # a window with an empty partition spec runs in a single task
    bad += ["unpartitioned Window" for n in json.loads(plan.toJSON())
            if n.get("class", "").endswith("WindowExec") and not n.get("partitionSpec")]
    return bad


@pytest.mark.parametrize("slug", SLUGS)
def test_query_matches_oracle(spark, con, slug):
    df = QUERIES[slug](spark, SF_SMALL)
    assert not _plan_problems(df), _plan_problems(df)
    problems = compare(df, con, ORACLES[slug])
    assert not problems, problems


@pytest.mark.parametrize("slug", ["timeline_hourly", "timeline_minute_of_day", "flow_window_features",
                                  "stream_timeline", "stream_flow_windows"])
def test_event_time_queries_ignore_session_zone(spark, con, slug):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        problems = compare(QUERIES[slug](spark, SF_SMALL), con, ORACLES[slug])
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert not problems, problems
