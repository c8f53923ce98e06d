"""Flow-shaped views over the driver's tables.

No flow captures ship with this repository, so the analytics run on views
derived from the given parquet tables.  Every view is a pure projection of a
scan (column pruning and filters reach the parquet reader); the "dirty"
variant injects missing / non-finite values by md5 bucket so the cleaning,
dropping and imputation paths do real work, identically in Spark and DuckDB.

Flow frame contract: ``row_id`` (unique string key), ``src_file``, numeric
feature columns, ``y`` (int8), ``attack_family``, ``cic_label``,
``report_name``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import clean_features
from ..functions.hashing import hash_bucket, with_once
from ..functions.labels import with_label_columns

LINEITEM_FEATURES = ["qty", "price", "disc", "tax", "net", "gross"]

# Fixed label texts given to lineitem return-flag/line-status groups.
LINEITEM_LABELS = {
    "AF": "DoS Hulk",
    "AO": "PortScan",
    "RF": "Web Attack - Brute Force",
    "RO": "Bot",
}
# Fixed raw label pools per event type (picked by md5 bucket of event_id);
# None is a missing label.
EVENT_LABEL_POOLS = {
    "view": ["BENIGN", " Benign ", "benign\t"],
    "click": [" DoS Hulk ", "DoS slowloris", "DoS Slowhttptest", "DoS GoldenEye"],
    "error": ["PortScan", "Infiltration - Portscan", "Heartbleed", "Infiltration"],
    "purchase": ["Web Attack - Brute Force", "Web Attack - XSS", "Web Attack - Sql Injection", "Web_Attack_BF"],
    "signup": ["FTP-Patator", "SSH-Patator", "DDoS", "Bot", None],
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Batch scan of one driver table.

    The test files are one row group each, so a scan is one task.  Only a
    session that sets ``flowsentry.spreadScans`` (the local one of tests and
    bench does) has such rows dealt to its cores; elsewhere the scan stays as
    it is."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spark.conf.get("flowsentry.spreadScans", "false") == "true":
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return df


def lineitem_flows(spark: SparkSession, sf_dir: str, dirty: bool = True,
                   with_labels: bool = True) -> DataFrame:
    return lineitem_flow_view(read_table(spark, sf_dir, "lineitem"), dirty, with_labels)


def lineitem_flow_view(li: DataFrame, dirty: bool = True, with_labels: bool = True) -> DataFrame:
    """Projection of a lineitem frame (batch or streaming) into flow shape."""
    row_id = F.concat_ws("-", *[F.col(c).cast("string") for c in
                                ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    grp = F.concat(F.col("l_returnflag"), F.col("l_linestatus"))
    label = F.when(F.col("l_returnflag") == "N", F.lit("BENIGN"))
    for k, v in LINEITEM_LABELS.items():
        label = label.when(grp == k, F.lit(v))
    label = label.otherwise(grp)
    price = F.col("l_extendedprice")
    net = price * (F.lit(1.0) - F.col("l_discount"))
    df = li.select(
        row_id.alias("row_id"),
        F.concat(F.lit("ship-"), F.year("l_shipdate").cast("string")).alias("src_file"),
        F.col("l_quantity").alias("qty"),
        price.alias("price"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
        net.alias("net"),
        (net * (F.lit(1.0) + F.col("l_tax"))).alias("gross"),
        label.alias("Label"),
    )
    if dirty:
        # the bucket is computed once; inlined, a filter on the split or the
        # label would hold one md5 per branch and overflow the code size limit
        df = with_once(df, "_dirt", hash_bucket("row_id", "dirt"))
        b = F.col("_dirt")
        inf = F.lit(float("inf"))
        df = df.withColumns({
            "price": F.when(b < 10, inf).otherwise(F.col("price")),
            "disc": F.when((b >= 10) & (b < 20), F.lit(float("nan"))).otherwise(F.col("disc")),
            "tax": F.when((b >= 20) & (b < 30), F.lit(None).cast("double")).otherwise(F.col("tax")),
            "qty": F.when((b >= 30) & (b < 35), -inf).otherwise(F.col("qty")),
            "Label": F.when((b >= 35) & (b < 40), F.lit(None).cast("string"))
                      .when((b >= 40) & (b < 60) & (F.col("Label") == "BENIGN"), F.lit(" BENIGN "))
                      .otherwise(F.col("Label")),
        })
        df = clean_features(df.drop("_dirt"), LINEITEM_FEATURES)
    return with_label_columns(df) if with_labels else df


def event_label_text() -> F.Column:
    """Raw label for an event: a fixed pool per event_type, md5-picked."""
    b = hash_bucket(F.col("event_id"), "label", 10_000)
    expr = None
    for et, pool in EVENT_LABEL_POOLS.items():
        arr = F.array(*[F.lit(v).cast("string") for v in pool])
        pick = F.element_at(arr, (b % F.lit(len(pool)) + 1).cast("int"))
        expr = (F.when(F.col("event_type") == et, pick) if expr is None
                else expr.when(F.col("event_type") == et, pick))
    return expr.otherwise(F.col("event_type"))


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    df = ev.select(
        F.col("event_id").cast("string").alias("row_id"),
        F.col("event_id"),
        F.col("event_type"),
        F.lit("events").alias("src_file"),
        F.col("value").cast("double").alias("value"),
        event_label_text().alias("Label"),
    )
    return with_label_columns(df)


def embedding_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("label") == 0, F.lit("BENIGN")).otherwise(
        F.concat(F.lit("class-"), F.col("label").cast("string")))
    df = em.select(
        F.col("vec_id").cast("string").alias("row_id"),
        F.lit("embeddings").alias("src_file"),
        F.transform("embedding", lambda v: v.cast("double")).alias("features"),
        label.alias("Label"),
    )
    return with_label_columns(df)
