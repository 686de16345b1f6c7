"""Rules on rows: one scan per table, and counted by the job that writes."""

import pytest

from weekloom.operators import quality
from weekloom.sources import publish

def v_rules():
    return [
        quality.null_rule("v.null", "v", ["k"]),
        quality.length_rule("v.length", "v", 2, ["k"]),
        quality.member_rule("v.member", "v", ["a"]),
    ]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "a"), (1, "abc"), (2, None), (2, None), (3, "abc")], "k int, v string")


def test_all_rules_in_one_scan(spark, rows, tmp_path):
    rows.write.parquet(f"{tmp_path}/t")
    out = quality.row_violations(spark.read.parquet(f"{tmp_path}/t"), v_rules())
    got = sorted(tuple(r) for r in out.select("check_name", "key", "n").collect())
    # Rows of a null or length rule stay single, values outside a list are counted.
    assert got == [("v.length", "1", 3), ("v.length", "3", 3), ("v.member", "abc", 2), ("v.null", "2", 1), ("v.null", "2", 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_counted_while_writing(spark, rows, tmp_path):
    table, seen = quality.observed(rows, v_rules())
    table.write.parquet(f"{tmp_path}/t")
    assert seen.get == {"v.null": 2, "v.length": 2, "v.member": 2}


def test_tables_that_break_rules_do_not_become_current(spark, rows, tmp_path):
    base = str(tmp_path / "tables")
    good, rules = rows.where("v = 'a'"), {"t": v_rules()}
    assert publish.publish(spark, base, {"t": good}, rules=rules) == 1
    with pytest.raises(publish.ConstraintError) as e:
        publish.publish(spark, base, {"t": rows, "other": good}, rules=rules)
    assert e.value.found == {"t": {"v.null": 2, "v.length": 2, "v.member": 2}}
    assert publish.current_version(spark, base).number == 1
    assert publish.read_published(spark, base, "t").count() == 1
    assert publish.publish(spark, base, {"t": rows.limit(0)}, rules=rules) == 2


def test_storyline_rules_name_every_declared_column(spark):
    rules = quality.storyline_rules()
    assert len(rules["weekly_keywords"]) == 7 and len(rules["weekly_topic"]) == 4
    assert {r.folds for r in rules["teams"]} == {True}
