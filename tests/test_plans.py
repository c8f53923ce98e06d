"""Physical-plan properties: pruning reaches the scan, expression paths stay
JVM-side, fold counts for all candidates come from one scan and aggregation."""

import re

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def _plan(df):
    df.collect()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def _read_schemas(plan):
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan)


def test_projection_prunes_scan_columns(spark):
    from flowsentry.sources.tables import lineitem_flows
    df = lineitem_flows(spark, SF_SMALL).select("row_id", "price")
    plan = _plan(df)
    cols = {c.split(":")[0] for s in _read_schemas(plan) for c in s.split(",")}
    assert cols == {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"}


def test_expression_study_has_no_python(spark):
    from flowsentry.plans.catalog import study
    st = study(spark, SF_SMALL)
    plan = _plan(st.ablation_metrics)
    assert "Python" not in plan and "ArrowEvalPython" not in plan


def test_fold_counts_single_scan_and_aggregation(spark):
    from flowsentry.operators import metrics as M
    rows = [(f"r{i}", i % 2, "A" if i % 4 == 1 else "B", "val" if i % 2 == 0 else None, float(i))
            for i in range(200)]
    df = spark.createDataFrame(rows, "row_id string, y int, family string, split string, s double")
    preds = {f"t{k}": F.col("s") > k for k in range(10)}
    final = _plan(M.fold_counts(df, preds, "family")).split("== Initial Plan ==")[0]
    # one scan and one partial/final aggregate pair feed the family rows and the benign row
    assert final.count("Scan ExistingRDD") == 1
    assert final.count("Exchange hashpartitioning") == 1


def test_reports_read_the_cube_alone(spark):
    from flowsentry.operators import reports as R
    from flowsentry.plans.catalog import study
    st = study(spark, SF_SMALL)
    for table in (R.class_by_nu_table(st), R.ae_table(st, "f1_macro"), R.accuracy_series(st), R.operating_points(st), st.thr_metrics):
        final = _plan(table).split("== Initial Plan ==")[0]
        assert "FileScan" not in final and final.count("Scan ExistingRDD") == 1


def test_scores_are_columnar_and_pruned_by_split(spark):
    from flowsentry.plans.catalog import study
    plan = _plan(study(spark, SF_SMALL).scored.where("split = 'val'").select("ae"))
    assert _read_schemas(plan) == ["ae:double"] and "PartitionFilters: [isnotnull(split" in plan
