"""Results of the study do not depend on how the work is dealt out."""

import pytest

from tests.conftest import SF_SMALL


def _run(spark):
    from flowsentry.plans.study import Study
    from flowsentry.sources.tables import LINEITEM_FEATURES, lineitem_flows
    st = Study(lineitem_flows(spark, SF_SMALL), LINEITEM_FEATURES)
    summary = {r["model"]: r.asDict() for r in st.ablation_summary().collect()}
    return st.prep, st.boundary.boundaries, st.thr_grid, st.best_fusion["thr"], summary


def test_study_is_partition_independent(spark):
    one = _run(spark)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("flowsentry.spreadScans", "false")
    try:
        other = _run(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("flowsentry.spreadScans", "true")
    assert other[0].medians == pytest.approx(one[0].medians)
    assert other[1] == pytest.approx(one[1])
    assert other[2] == pytest.approx(one[2])
    assert other[3] == pytest.approx(one[3])
    for model, row in one[4].items():
        for k, v in row.items():
            if isinstance(v, float):
                assert other[4][model][k] == pytest.approx(v, abs=1e-12), (model, k)
            else:
                assert other[4][model][k] == v


def test_inclusive_one_class_decision(spark):
    """A score on the boundary is an anomaly in the ablation, not in the sweep."""
    from flowsentry.functions.expr import flag_ge, flag_gt
    df = spark.createDataFrame([(0.0,), (-1.0,), (1.0,)], "s double")
    assert [tuple(r) for r in df.select(flag_ge("s", 0.0).cast("int"), flag_gt("s", 0.0).cast("int")).collect()] == [
        (1, 0), (0, 0), (1, 1)]


def test_a_filter_on_the_split_does_not_repeat_the_dirt_hash(spark):
    """The bucket that makes the view dirty is hashed once, however many
    columns a filter on the split hangs on."""
    from flowsentry.operators import sampling as S
    from flowsentry.sources.tables import LINEITEM_FEATURES, lineitem_flows
    lf = S.assign_split(lineitem_flows(spark, SF_SMALL), LINEITEM_FEATURES)
    train = lf.where("split = 'train'").select("row_id")
    plan = train._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(":dirt") == 1
    assert train.count() == lf.select("split").collect().count(("train",))


def test_study_hashes_keys_once_into_a_written_working_set(spark):
    """The split is in the working set, which is a written table and takes no
    memory."""
    from flowsentry.operators.sampling import assign_split
    from flowsentry.plans.study import Study
    from flowsentry.sources.tables import LINEITEM_FEATURES, lineitem_flows
    flows = lineitem_flows(spark, SF_SMALL)
    st = Study(flows, LINEITEM_FEATURES)
    assert "split" in st.base.columns and not st.base.storageLevel.useMemory and st.base.inputFiles()
    want = {tuple(r) for r in assign_split(flows, LINEITEM_FEATURES).select("row_id", "split").collect()}
    assert {tuple(r) for r in st.split_frame.select("row_id", "split").collect()} == want
