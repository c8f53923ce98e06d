"""Label handling: binary label, coarse attack family, report row name.

All three are native Catalyst expressions (``when`` chains over ``contains``),
so they stay inside whole-stage codegen; no Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference for identical results.
BENIGN_TEXT = "benign"
MISSING_LABEL_TEXT = "nan"  # a missing label reads as the text 'nan' (and so counts as an attack)
BENIGN_REPORT_ROW = "Benign (Validation)"
FAMILY_BENIGN = "Benign"
# Coarse family cascade, first match wins (substring tests on the lower-cased label):
#   == benign -> Benign; heartbleed -> Heartbleed; "web attack" or "webattack" -> WebAttack;
#   portscan -> PortScan; dos and not ddos -> DoS; ddos -> DDoS; bot -> Bot;
#   infiltration -> Infiltration; otherwise the label itself.
# Report-row cascade (lower-cased, '_' read as ' '), first match wins:
#   == benign -> Benign (Validation); ftp and patator -> FTP Bruteforce;
#   ssh and patator -> SSH Bruteforce; slowloris -> DoS (Slowloris);
#   goldeneye -> DoS (GoldenEye); hulk -> DoS (Hulk);
#   slowhttptest or slowhttps -> DoS (Slowhttps); ddos -> DDoS;
#   dos and not ddos -> DoS (other); heartbleed -> Heartbleed;
#   web and (bf or brute) -> Web BF; xss -> Web XSS; sql -> Web SQL;
#   infiltration -> Infiltration; bot -> Botnet; portscan -> PortScan;
#   otherwise the stripped label.

_UNICODE_STRIP = r"(?U)^\s+|\s+$"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: all Unicode whitespace, both ends."""
    return F.regexp_replace(c, _UNICODE_STRIP, "")


def clean_label(label: Column | str) -> Column:
    """Raw label text as the reference sees it: missing -> 'nan', stripped."""
    c = F.col(label) if isinstance(label, str) else label
    return py_strip(F.coalesce(c.cast("string"), F.lit(MISSING_LABEL_TEXT)))


def binary_label(clean: Column | str) -> Column:
    """B1: 0 for benign, 1 for anything else (including 'nan'); int8."""
    c = F.col(clean) if isinstance(clean, str) else clean
    return F.when(F.lower(c) == F.lit(BENIGN_TEXT), 0).otherwise(1).cast("byte")


def _family_cascade(s: Column, low: Column) -> Column:
    has = low.contains
    return (
        F.when(low == F.lit("benign"), F.lit("Benign"))
        .when(has("heartbleed"), F.lit("Heartbleed"))
        .when(has("web attack") | has("webattack"), F.lit("WebAttack"))
        .when(has("portscan"), F.lit("PortScan"))
        .when(has("dos") & ~has("ddos"), F.lit("DoS"))
        .when(has("ddos"), F.lit("DDoS"))
        .when(has("bot"), F.lit("Bot"))
        .when(has("infiltration"), F.lit("Infiltration"))
        .otherwise(s)
    )


def _report_cascade(s: Column, low: Column) -> Column:
    has = low.contains
    return (
        F.when(low == F.lit("benign"), F.lit("Benign (Validation)"))
        .when(has("ftp") & has("patator"), F.lit("FTP Bruteforce"))
        .when(has("ssh") & has("patator"), F.lit("SSH Bruteforce"))
        .when(has("slowloris"), F.lit("DoS (Slowloris)"))
        .when(has("goldeneye"), F.lit("DoS (GoldenEye)"))
        .when(has("hulk"), F.lit("DoS (Hulk)"))
        .when(has("slowhttptest") | has("slowhttps"), F.lit("DoS (Slowhttps)"))
        .when(has("ddos"), F.lit("DDoS"))
        .when(has("dos") & ~has("ddos"), F.lit("DoS (other)"))
        .when(has("heartbleed"), F.lit("Heartbleed"))
        .when(has("web") & (has("bf") | has("brute")), F.lit("Web BF"))
        .when(has("xss"), F.lit("Web XSS"))
        .when(has("sql"), F.lit("Web SQL"))
        .when(has("infiltration"), F.lit("Infiltration"))
        .when(has("bot"), F.lit("Botnet"))
        .when(has("portscan"), F.lit("PortScan"))
        .otherwise(s)
    )


def attack_family(clean: Column | str) -> Column:
    """B2: coarse family; NUL characters are removed first."""
    c = F.col(clean) if isinstance(clean, str) else clean
    s = F.replace(c, F.lit("\x00"), F.lit(""))
    return _family_cascade(s, F.lower(s))


def report_row_name(clean: Column | str) -> Column:
    """Row name used by the per-class report tables."""
    c = F.col(clean) if isinstance(clean, str) else clean
    s = py_strip(c)
    return _report_cascade(s, F.replace(F.lower(s), F.lit("_"), F.lit(" ")))


def with_label_columns(df: DataFrame, label_col: str = "Label", drop_raw: bool = True) -> DataFrame:
    """Adds ``y``, ``attack_family``, ``cic_label`` and ``report_name``.

    The lower-cased texts the cascades test are materialised once as helper
    columns, so each branch reads a column instead of repeating the string
    functions (smaller generated code, one evaluation per row)."""
    out = df.withColumn("cic_label", clean_label(label_col))
    out = out.withColumns({
        "_fam_s": F.replace(F.col("cic_label"), F.lit("\x00"), F.lit("")),
        "_rep_low": F.replace(F.lower(F.col("cic_label")), F.lit("_"), F.lit(" ")),
    }).withColumn("_fam_low", F.lower(F.col("_fam_s")))
    out = out.withColumns({
        "y": binary_label("cic_label"),
        "attack_family": _family_cascade(F.col("_fam_s"), F.col("_fam_low")),
        "report_name": _report_cascade(F.col("cic_label"), F.col("_rep_low")),
    }).drop("_fam_s", "_fam_low", "_rep_low")
    return out.drop(label_col) if drop_raw and label_col in df.columns else out
