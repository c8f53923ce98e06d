"""Label cascade (B1-B3) against the literal table in FIXTURES.md section 2."""

import pytest
from pyspark.sql import functions as F

from flowsentry.functions.labels import with_label_columns

CASES = [
    ("BENIGN", 0, "Benign", "Benign (Validation)"),
    (" Benign ", 0, "Benign", "Benign (Validation)"),
    ("DoS Hulk", 1, "DoS", "DoS (Hulk)"),
    ("DoS slowloris", 1, "DoS", "DoS (Slowloris)"),
    ("DoS Slowhttptest", 1, "DoS", "DoS (Slowhttps)"),
    ("DoS GoldenEye", 1, "DoS", "DoS (GoldenEye)"),
    ("DoS Foo", 1, "DoS", "DoS (other)"),
    ("DDoS", 1, "DDoS", "DDoS"),
    ("PortScan", 1, "PortScan", "PortScan"),
    ("FTP-Patator", 1, "FTP-Patator", "FTP Bruteforce"),
    ("SSH-Patator", 1, "SSH-Patator", "SSH Bruteforce"),
    ("Web Attack - Brute Force", 1, "WebAttack", "Web BF"),
    ("Web Attack - XSS", 1, "WebAttack", "Web XSS"),
    ("Web Attack - Sql Injection", 1, "WebAttack", "Web SQL"),
    ("Web_Attack_BF", 1, "Web_Attack_BF", "Web BF"),
    ("Heartbleed", 1, "Heartbleed", "Heartbleed"),
    ("Infiltration", 1, "Infiltration", "Infiltration"),
    ("Infiltration - Portscan", 1, "PortScan", "Infiltration"),
    ("Bot", 1, "Bot", "Botnet"),
    (None, 1, "nan", "nan"),
    ("BENIGN\x00", 1, "Benign", "BENIGN\x00"),
    ("Unknown", 1, "Unknown", "Unknown"),
    ("\u00a0BENIGN\u2003", 0, "Benign", "Benign (Validation)"),  # Unicode whitespace strip
]


@pytest.fixture(scope="module")
def labelled(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, Label string")
    return {r["i"]: r for r in with_label_columns(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cascade(labelled, i):
    raw, y, fam, rep = CASES[i]
    r = labelled[i]
    assert (r["y"], r["attack_family"], r["report_name"]) == (y, fam, rep), raw


def test_label_types(spark):
    df = with_label_columns(spark.createDataFrame([("BENIGN",)], "Label string"))
    assert dict(df.dtypes)["y"] == "tinyint"
    assert "Label" not in df.columns


def test_cascade_stays_in_codegen(spark):
    df = with_label_columns(spark.range(10).select(F.lit("DoS Hulk").alias("Label")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
