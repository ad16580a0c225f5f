from obsweave.plans import deciding


def test_menus_and_guarded_columns_are_made_once(spark):
    plan = deciding.label_unify(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # both sides of the join on labels used to go back to lineitem twice
    assert "lineitem.parquet" not in plan and "l_suppkey" not in plan
