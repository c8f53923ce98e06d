"""Driver contract: entry runs at sf0.001; every oracle key is a registered query."""

from __spark_entry__ import entry, oracle_sql, queries


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r["model"] for r in rows} == {"ML_only_OC_SVM", "DL_only_AE", "Hybrid_fusion"}


def test_oracle_keys_registered():
    assert set(oracle_sql()) <= set(queries())
    assert len(oracle_sql()) >= 35
