"""Cleaning of the locker's entry table."""

from veilspark.operators.locker import locker_clean

ENTRY = "pos bigint, name string, value string, action string, enabled boolean, kind string"


def test_the_first_entry_of_a_name_is_chosen_without_its_value(spark):
    long = "v" * 10_000
    rows = [(3, "a", long, "mask", True, "value"), (1, " a ", long + "1", "block", True, "value"), (2, "b", "/x/secret.txt", "block", True, "path"), (0, "a", "s", "mask", True, "value")]
    out = locker_clean(spark.createDataFrame(rows, ENTRY))
    assert sorted((r.pos, r.name, len(r.value), r.action) for r in out.collect()) == [(1, "a", 10_001, "block"), (2, "b", 13, "mask")]
    # The values pass no aggregate before the choice.
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
