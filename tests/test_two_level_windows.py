"""The bucketed (two-level) lag / lead / running sums equal the plain per-user windows.

With one period per bucket nearly every record sits at a bucket edge, so the cross-bucket
path carries the result; the DuckDB oracle uses plain per-user windows.
"""
import pytest

from tests.conftest import SF_CHECK
from tests.oracle_harness import compare, duck
from transitio.operators import pairs as PR


@pytest.mark.parametrize("name", ["transition_labels", "transition_labels_p7", "forecast_pairs", "history_average",
                                  "adjacent_pairs", "prompt_table"])
def test_small_buckets_match_oracle(spark, monkeypatch, name):
    from __spark_entry__ import oracle_sql, queries
    monkeypatch.setattr(PR, "BUCKET_PERIODS", 1)
    r = compare(spark, duck(SF_CHECK), name, queries()[name], oracle_sql()[name], SF_CHECK)
    assert r["ok"], r


def test_nested_chunks_cover_all_records(spark):
    from __spark_entry__ import oracle_sql, queries
    from transitio.operators import sequences as SQ
    orig = SQ.nest_user_records

    def small_chunks(records, features, chunk_days=366):
        return orig(records, features, chunk_days=7)
    import transitio.plans.catalog as C
    mp = pytest.MonkeyPatch()
    mp.setattr(C.SQ, "nest_user_records", small_chunks)
    try:
        r = compare(spark, duck(SF_CHECK), "nest_user_records", queries()["nest_user_records"],
                    oracle_sql()["nest_user_records"], SF_CHECK)
    finally:
        mp.undo()
    assert r["ok"], r
