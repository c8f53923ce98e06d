"""The deploy stream resumes from its checkpoint (new files only) and the
union of its outputs equals the batch deploy projection."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def test_stream_resumes_and_matches_batch(spark, tmp_path):
    from flowsentry.plans.catalog import study
    from flowsentry.sources.artifacts import fusion_config_from_study
    from flowsentry.sources.tables import lineitem_flow_view, read_table
    from flowsentry.streaming.score_stream import deploy, expression_scorer

    st = study(spark, SF_SMALL)
    cfg = fusion_config_from_study(st)
    bnd = st.boundary.boundaries[st.boundary.nus.index(st.best_nu)]
    scorer = expression_scorer(st.prep, bnd)
    table = pq.read_table(f"{SF_SMALL}/lineitem.parquet")
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    schema = read_table(spark, SF_SMALL, "lineitem").schema
    half = table.num_rows // 2

    def drain():
        raw = spark.readStream.schema(schema).parquet(str(inbox))
        q = (deploy(lineitem_flow_view(raw), scorer, cfg).writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", chk)
             .trigger(availableNow=True).start())
        q.awaitTermination()

    pq.write_table(table.slice(0, half), str(inbox / "part-0.parquet"))
    drain()
    assert spark.read.parquet(out).count() == half
    pq.write_table(table.slice(half), str(inbox / "part-1.parquet"))
    drain()
    streamed = spark.read.parquet(out)
    assert streamed.count() == table.num_rows
    batch = deploy(lineitem_flow_view(read_table(spark, SF_SMALL, "lineitem")), scorer, cfg)
    diff = streamed.select("row_id", F.round("z", 9).alias("z"), "pred").exceptAll(
        batch.select("row_id", F.round("z", 9).alias("z"), "pred"))
    assert diff.count() == 0
