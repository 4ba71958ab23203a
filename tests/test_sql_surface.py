"""Table functions and bucketed tables: errors, and plans without shuffles."""

import pytest

from paperlens.functions.sql import register
from paperlens.operators import relational as R
from paperlens.plans import sql

TINY = "/root/testdata/sf0.001"


def test_no_shuffle_between_parents_and_children(spark):
    papers, items = sql.library(spark, TINY)
    both = R.with_counts(R.nested(papers, items, "paper_id", ["order_index", "flag", "part"], ["flag"]), "paper_id", items=items)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" in plan and "Exchange" not in plan


def test_bad_calls_say_what_is_missing(spark):
    register(spark)
    with pytest.raises(Exception, match="columns are missing: size"):
        spark.sql("SELECT * FROM pack_batches(TABLE(SELECT 1 AS grp, 2 AS ord), 1, 2)").collect()
    with pytest.raises(Exception, match="TABLE argument"):
        spark.sql("SELECT * FROM parse_paper(3)").collect()
    assert spark.sql("SELECT exam_percent(5, 0), exam_percent(7, 4), exam_masked(NULL), exam_section_type(46)").first()[:] == (0, 100, None, "reading_careful")
