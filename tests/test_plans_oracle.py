"""Plan shape checks and the DuckDB oracle on the smallest scale factor."""
import pytest

from tests.conftest import SF_SMALL
from tests.oracle_harness import compare, duck

HEAVY = {"rf_study", "gbt_study", "study_runs"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["transition_labels", "few_shot_pairs", "interval_join_sum", "oversample",
                                  "chat_test", "history_average", "confusion_matrix", "shots_curve"])
def test_no_cartesian_or_nested_loop(spark, name):
    from __spark_entry__ import queries
    plan = _plan(queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_scan_prunes_columns(spark):
    from __spark_entry__ import queries
    df = queries()["battery_daily"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan and "event_id" not in plan


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    assert entry(spark).count() >= 0


def test_all_oracles_match_smallest_sf(spark):
    from __spark_entry__ import oracle_sql, queries
    con = duck(SF_SMALL)
    sqls = oracle_sql()
    bad = []
    for name, fn in queries().items():
        if name in HEAVY or name not in sqls:
            continue
        r = compare(spark, con, name, fn, sqls[name], SF_SMALL)
        if not r["ok"]:
            bad.append(r)
    assert not bad, bad


def test_no_raw_dates_at_the_contract(spark):
    """Dates cross the driver contract as ISO text on both sides (DATE_COLUMNS kept in sync)."""
    from pyspark.sql import types as T
    from __spark_entry__ import oracle_sql, queries
    con = duck(SF_SMALL)
    for name, fn in queries().items():
        if name in HEAVY:
            continue
        df = fn(spark, SF_SMALL)
        assert not [f for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType))], name
        sql = oracle_sql().get(name)
        if sql:
            types = [str(d[1]) for d in con.execute(sql).description]
            assert not [t for t in types if t.upper().startswith(("DATE", "TIMESTAMP"))], (name, types)
