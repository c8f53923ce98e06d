"""Multi-file flow CSV scan.

One scan per distinct header reads the capture files (chunking disappears: the
scan is split by Spark).  Columns arrive as strings; header names are stripped and
de-duplicated; a column is a feature when every non-empty value parses as a
number, decided by one aggregate over all columns (the per-chunk dtype
inference of a pandas reader is replaced by one fixed, data-wide rule);
values are read with ``try_cast`` so junk becomes missing instead of failing.
"""

from __future__ import annotations

import csv
import posixpath
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import narrow_float32, nonfinite_to_null
from ..functions.labels import with_label_columns

# Fixed capture file names of the reference data set (the completeness check).
CAPTURE_FILES = [
    "Monday-WorkingHours.pcap_ISCX.csv",
    "Tuesday-WorkingHours.pcap_ISCX.csv",
    "Wednesday-workingHours.pcap_ISCX.csv",
    "Thursday-WorkingHours-Morning-WebAttacks.pcap_ISCX.csv",
    "Thursday-WorkingHours-Afternoon-Infilteration.pcap_ISCX.csv",
    "Friday-WorkingHours-Morning.pcap_ISCX.csv",
    "Friday-WorkingHours-Afternoon-PortScan.pcap_ISCX.csv",
    "Friday-WorkingHours-Afternoon-DDos.pcap_ISCX.csv",
]
LABEL = "Label"


class MissingCaptureFiles(FileNotFoundError):
    pass


class MissingLabel(ValueError):
    pass


def list_files(spark: SparkSession, data_dir: str, glob: str = "*.csv") -> DataFrame:
    """(path, name, length) of the files under ``data_dir`` (contents are
    not read: only metadata columns are selected)."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true").load(data_dir)
            .select("path", "length")
            .withColumn("name", F.element_at(F.split("path", "/"), -1)))


def check_complete(spark: SparkSession, data_dir: str, expected: list[str] | None = None) -> None:
    """A4: every expected capture file must exist; missing names -> error."""
    expected = CAPTURE_FILES if expected is None else expected
    want = spark.createDataFrame([(n,) for n in expected], "name string")
    have = list_files(spark, data_dir).select("name")
    missing = [r[0] for r in want.join(have, "name", "left_anti").collect()]
    if missing:
        raise MissingCaptureFiles(f"missing capture files under {data_dir}: {sorted(missing)}")


def normalise_headers(cols: list[str]) -> list[str]:
    """A2: strip names; repeated names get a numeric suffix (name__1, ...)."""
    seen: dict[str, int] = {}
    out = []
    for c in cols:
        s = c.strip()
        k = seen.get(s, 0)
        out.append(s if k == 0 else f"{s}__{k}")
        seen[s] = k + 1
    return out


def read_headers(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Normalised header -> its files.  Each file's first line is read by a
    one-row job; files without any line are left out."""
    def header(path: str) -> tuple[str, ...] | None:
        line = spark.read.text(path).where(F.trim("value") != "").first()
        return tuple(normalise_headers(next(csv.reader([line[0].lstrip("\ufeff")])))) if line else None

    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(header, paths))
    out: dict[tuple[str, ...], list[str]] = {}
    for path, cols in zip(paths, found):
        if cols:
            out.setdefault(cols, []).append(path)
    return out


def _scan(spark: SparkSession, cols: tuple[str, ...], paths: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
    return (spark.read.option("header", True).schema(schema).csv(paths)
            .withColumn("src_file", F.col("_metadata.file_name")))


def _as_number(c: str):
    return F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)")


def read_flow_csv(spark: SparkSession, data_dir: str, files: list[str] | None = CAPTURE_FILES,
                  check: bool = True, key_col: str | None = None,
                  float32: bool = False, align_by_name: bool = True,
                  features: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Returns (flow frame, feature names) of the captures under ``data_dir``.

    ``files`` names the capture files (checked for completeness when
    ``check``); None scans every ``*.csv`` below the folder.  Every file must
    have a Label column.  See ``read_flow_files``."""
    if files is None:
        paths = sorted(r[0] for r in list_files(spark, data_dir).select("path").collect())
    else:
        if check:
            check_complete(spark, data_dir, files)
        paths = [posixpath.join(data_dir, f) for f in files]
    found = read_flow_files(spark, paths, key_col, float32, align_by_name, features)
    if found is None:
        raise MissingCaptureFiles(f"no capture file with a header under {data_dir}")
    return found


def read_flow_files(spark: SparkSession, paths: list[str], key_col: str | None = None, float32: bool = False,
                    align_by_name: bool = True, features: list[str] | None = None,
                    need_label: bool = True) -> tuple[DataFrame, list[str]] | None:
    """(flow frame, feature names) of capture files, None if none has a header.

    Flow frame: row_id, src_file, features (double, +-inf/NaN -> null), y,
    attack_family, cic_label, report_name.  ``row_id`` is md5 of the source
    file and the raw row unless ``key_col`` names a supplied key.

    Columns go by name: files are grouped by their header, each distinct header
    is one scan, and the scans are united by column name (H1); missing columns
    become null.  With ``align_by_name=False`` the caller states that all files
    have the first one's header, and no other header is read.

    ``features`` states the feature columns (all others but the key and the
    label are left alone, absent ones are null); without it one more pass over
    the text decides which columns are numeric.  With ``need_label=False``
    files without a Label column are read, and if none has one the four label
    columns are left out."""
    if align_by_name:
        headers = read_headers(spark, paths)
    else:
        headers = {cols: paths for cols in read_headers(spark, paths[:1])}
    if not headers:
        return None
    unlabelled = sorted(f for cols, group in headers.items() if LABEL not in cols for f in group)
    if unlabelled and need_label:
        raise MissingLabel(f"no {LABEL} column in {unlabelled}")
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                 [_scan(spark, cols, group) for cols, group in headers.items()])
    names = [c for c in raw.columns if c != "src_file"]
    if features is None:
        # one aggregate decides which columns are numeric everywhere (A3)
        candidates = [c for c in names if c != LABEL and c != key_col]
        bad = raw.agg(*[F.sum((F.col(f"`{c}`").isNotNull() & (F.trim(F.col(f"`{c}`")) != "")
                               & _as_number(c).isNull()).cast("long")).alias(f"b{i}")
                        for i, c in enumerate(candidates)]).first()
        features = [c for i, c in enumerate(candidates) if not (bad[f"b{i}"] or 0)]
    raw_concat = F.concat_ws("\u001f", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in names])
    row_id = (F.col(f"`{key_col}`").cast("string") if key_col
              else F.md5(F.concat_ws("\u001e", F.col("src_file"), raw_concat)))
    number = lambda c: nonfinite_to_null(_as_number(c)) if c in names else F.lit(None).cast("double")
    labelled = LABEL in names
    flows = raw.select(row_id.alias("row_id"), "src_file", *[number(c).alias(c) for c in features],
                       *([F.col(LABEL)] if labelled else []))
    if float32:
        flows = narrow_float32(flows, features)
    return (with_label_columns(flows, LABEL) if labelled else flows), list(features)
