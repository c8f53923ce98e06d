"""URL rules by a sorted digest array (operator 10).

A rule (host, path, verdict) fits its host and all subdomains when the url's
path starts with the rule's; the longest fitting rule gives the verdict.

The rule list becomes a sorted array of 64-bit xxhash keys beside the stored
rule strings.  The files are shipped with ``SparkContext.addFile`` and
memory-mapped by the workers, which probe all (host suffix, path prefix)
candidates of a batch with one vectorised binary search and confirm each hit
against the stored string, so a digest collision can't judge a url.

The array is made for at most ``MAX_RULES`` rules (the size of what each
executor receives); a longer list is joined by Spark on the same candidates.

Defined cases: a null url, or one without ``://``, has an empty host and path
and fits no rule.  No fitting rule gives a null rule and the default verdict.
Rules with a null host or path are dropped; of rules repeated for one host
and path, a block stands over an allow.  Of fitting rules of equal length the
longer host wins.  Columns of the input other than id and url are not read.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.llm.common import texts

MAX_RULES = 2_000_000
ALLOW, BLOCK = "allow", "block"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end,
    A-Z in lower case.  Path: from there up to ``?``, ``#`` or the end."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    if slash < 0:
        return rest.translate(_LOWER), ""
    return rest[:slash].translate(_LOWER), rest[slash:]


def suffixes(host: str) -> list[str]:
    """The host and its parent domains, longest first."""
    out = [host] if host else []
    dot = host.find(".")
    while dot >= 0:
        if dot + 1 < len(host):
            out.append(host[dot + 1:])
        dot = host.find(".", dot + 1)
    return out


def key_of(host: str, path: str) -> bytes:
    return f"{host}\n{path}".encode()


class RuleArray:
    """Sorted digests with their rule strings, over memory-mapped files."""

    def __init__(self, digests: np.ndarray, ends: np.ndarray, strings, block: np.ndarray, lengths: np.ndarray):
        self.digests, self.ends, self.strings, self.block, self.lengths = digests, ends, strings, block, lengths

    @classmethod
    def write(cls, rules: list[tuple[str, str, str]], folder: str) -> str:
        """Files of the rules in ``folder``; their common name tells the content."""
        best: dict[bytes, bool] = {}
        for host, path, verdict in rules:
            k = key_of(host.translate(_LOWER), path)
            best[k] = best.get(k, False) or verdict == BLOCK
        rows = sorted((xxhash.xxh64_intdigest(k), k, b) for k, b in best.items())
        blob = b"".join(k for _, k, _ in rows)
        parts = {
            "digests": np.array([d for d, _, _ in rows], dtype=np.uint64),
            "ends": np.cumsum([len(k) for _, k, _ in rows], dtype=np.int64),
            "block": np.array([b for _, _, b in rows], dtype=bool),
            "strings": np.frombuffer(blob, dtype=np.uint8),
            "lengths": np.array(sorted({len(p) for _, p, _ in rules}, reverse=True), dtype=np.int64),
        }
        stamp = hashlib.sha256()
        for name in sorted(parts):
            stamp.update(parts[name].tobytes())
        name = f"urlrules-{stamp.hexdigest()[:24]}"
        for part, array in parts.items():
            np.save(os.path.join(folder, f"{name}-{part}.npy"), array)
        return name

    @classmethod
    def open(cls, path_of) -> RuleArray:
        """``path_of``: the local path of a part."""
        load = lambda part: np.load(path_of(part), mmap_mode="r")
        return cls(load("digests"), load("ends"), load("strings"), load("block"), load("lengths"))

    def stored(self, i: int) -> bytes:
        return self.strings[self.ends[i - 1] if i else 0:self.ends[i]].tobytes()

    def judge(self, urls: list[tuple[str, str]]) -> list[tuple[str, str, bool] | None]:
        """For each (host, path) the longest fitting (host, path, block)."""
        owner, keys = [], []
        lengths = [int(n) for n in self.lengths]
        for u, (host, path) in enumerate(urls):
            for s in suffixes(host):
                for n in lengths:
                    if n <= len(path):
                        owner.append(u)
                        keys.append(key_of(s, path[:n]))
        out: list = [None] * len(urls)
        if not keys or not len(self.digests):
            return out
        probe = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))
        first = np.searchsorted(self.digests, probe, side="left")
        hit = np.flatnonzero((first < len(self.digests)) & (self.digests[np.minimum(first, len(self.digests) - 1)] == probe))
        for c in hit:
            i = int(first[c])
            while i < len(self.digests) and self.digests[i] == probe[c]:
                if self.stored(i) == keys[c]:
                    host, _, path = keys[c].decode().partition("\n")
                    now = out[owner[c]]
                    if now is None or (len(host) + len(path), len(host)) > (len(now[0]) + len(now[1]), len(now[0])):
                        out[owner[c]] = (host, path, bool(self.block[i]))
                    break
                i += 1
        return out


_SHIPPED: set[tuple[str, str]] = set()
_OPEN: dict[str, RuleArray] = {}


def _ship(spark: SparkSession, rules: list[tuple[str, str, str]]) -> str:
    """Send the rule files to all executors; once for the same rules."""
    folder = tempfile.mkdtemp(prefix="urlrules-")   # addFile serves the driver's copy to executors
    name = RuleArray.write(rules, folder)
    sc = spark.sparkContext
    if (sc.applicationId, name) not in _SHIPPED:
        for part in ("digests", "ends", "strings", "block", "lengths"):
            sc.addFile(os.path.join(folder, f"{name}-{part}.npy"))
        _SHIPPED.add((sc.applicationId, name))
    return name


def _opened(name: str) -> RuleArray:
    if name not in _OPEN:
        _OPEN[name] = RuleArray.open(lambda part: SparkFiles.get(f"{name}-{part}.npy"))
    return _OPEN[name]


def _parsed(urls: DataFrame, id_col: str, url_col: str, judge) -> DataFrame:
    schema = T.StructType([
        T.StructField(id_col, urls.schema[id_col].dataType), T.StructField("host", T.StringType()),
        T.StructField("path", T.StringType()), T.StructField("rule_host", T.StringType()),
        T.StructField("rule_path", T.StringType()), T.StructField("block", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [host_and_path(u) for u in texts(batch.column(1))]
            got = judge(parsed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in parsed], pa.string()), pa.array([p for _, p in parsed], pa.string()),
                 *[pa.array([g and g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.string()))],
                 pa.array([None if g is None else g[2] for g in got], pa.bool_())], names=schema.names)

    return urls.select(id_col, F.col(url_col).alias("url")).mapInArrow(run, schema)


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = ALLOW, max_rules: int = MAX_RULES) -> DataFrame:
    """One row per url: id, host, path, rule (host and path without the
    leading ``/`` doubled, e.g. ``example.com/en/``), verdict.
    ``rules``: columns host, path, verdict (allow or block)."""
    rules = rules.select("host", "path", "verdict").dropna(subset=["host", "path"])
    if rules.limit(max_rules + 1).count() <= max_rules:
        name = _ship(urls.sparkSession, [tuple(r) for r in rules.collect()])
        out = _parsed(urls, id_col, url_col, lambda parsed: _opened(name).judge(parsed))
    else:
        out = _joined(urls, rules, id_col, url_col)
    return out.select(
        id_col, "host", "path", F.concat("rule_host", "rule_path").alias("rule"),
        F.when(F.col("block"), BLOCK).when(~F.col("block"), ALLOW).otherwise(default).alias("verdict"))


def _joined(urls: DataFrame, rules: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """The same by a join on (host suffix, path prefix), for rule lists past
    the array's bound.  Distinct (host, path) pairs are judged once."""
    parsed = _parsed(urls, id_col, url_col, lambda p: [None] * len(p)).select(id_col, "host", "path")
    rules = (rules.select(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("rule_host"),
                          F.col("path").alias("rule_path"), "verdict")
             .groupBy("rule_host", "rule_path").agg(F.max(F.col("verdict") == BLOCK).alias("block")))
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_distinct(F.filter(F.transform(
        F.array(*[F.lit(n) for n in lengths]), lambda n: F.when(F.length("path") >= n, F.substr("path", F.lit(1), n))),
        lambda p: p.isNotNull()))
    hits = (parsed.select("host", "path").distinct()
            .select("host", "path", F.explode(hosts).alias("rule_host"), prefixes.alias("prefixes"))
            .select("host", "path", "rule_host", F.explode("prefixes").alias("rule_path"))
            .join(rules, ["rule_host", "rule_path"]))
    size = F.length("rule_host") + F.length("rule_path")
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(size.alias("size"), F.length("rule_host").alias("n"), "rule_host", "rule_path", "block")).alias("r"))
    return (parsed.join(best, ["host", "path"], "left")
            .select(id_col, "host", "path", "r.rule_host", "r.rule_path", "r.block"))
