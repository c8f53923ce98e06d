"""Collocations, lexical search and quality rules against plain versions, and
on odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowsentry.llm import catalog, collocations, lexical_search, quality_rules
from tests.conftest import SF_SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, "A plain text about rivers and dogs.", "en"), (2, None, "en"), (3, "", None), (4, "  \n\t ", "en"),
       (5, "one two  three\tfour " * 9000, "en"), (6, "Hi.", "fr"), (6, "Hi.", "fr"), (7, "12 !! 34 %%", None),
       (None, "A text without an id but with words in it.", "en"), (8, "x" * 70_000, ""), (9, "Ünïcödé 漢字 😀 текст\x00 a\x1cb", "de"),
       (10, "\n".join(["same line here"] * 40), "en")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    for c in ("n", "score", "phrase", "id", "item", "rank", "_hash", "bucket", "words", "_group"):
        df = df.withColumn(c, F.lit("clash"))
    return df.coalesce(2)


# ------------------------------------------------------------------ 11
def plain_collocations(docs, least, top):
    """{lang: [(phrase, a, l, r, n, score)]} by dictionaries."""
    f = defaultdict(Counter)
    for text, lang in docs:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, c in f.items():
        n = sum(x for g, x in c.items() if len(g) == 1)
        cand = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        gone = {g[i:i + 2] for g, a in cand.items() if len(g) == 3 for i in (0, 1) if 100 * a >= 50 * cand[g[i:i + 2]]}
        rows = []
        for g, a in cand.items():
            if g not in gone:
                s, k = min((1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
                rows.append((" ".join(g), a, c[g[:k]], c[g[k:]], n, s))
        rows.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        if rows:
            out[lang] = rows[:top]
    return out


def mined(df, **options):
    out = defaultdict(list)
    for r in collocations.mine(df, **options).orderBy("lang", "rank").collect():
        out[r["lang"]].append((r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]))
        assert r["rank"] == len(out[r["lang"]]) and r["words"] == len(r["phrase"].split(" "))
    return dict(out)


def prose(seed, n, size=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(size)]
    out = []
    while len(out) < n:
        if rng.random() < 0.1:
            out += rng.choice([["new", "york"], ["new", "york", "city"], ["Prime", "Minister", "of"], ["x", "y"]])
        else:
            out.append(vocabulary[min(int(rng.expovariate(0.1)), size - 1)] + rng.choice(["", "", "", ",", ".", "  ", "\t", "\n"]))
    return " ".join(out)


@pytest.mark.parametrize("top", [3, 40, 5000])
def test_collocations_against_dictionary(spark, top):
    docs = [(prose(i, 300), ["en", "fr", None][i % 3]) for i in range(40)]
    df = spark.createDataFrame(docs, "text string, lang string").repartition(4)
    assert mined(df, least=5, top=top) == plain_collocations(docs, 5, top)


def test_collocations_need_more_waves(spark):
    """Most of the best pairs are dropped, so the frontier goes deeper."""
    docs = [(" . ".join(f"a{i} b{i} c{i}" for i in range(60)) + " . " + prose(9, 400), "en")] * 6
    want = plain_collocations(docs, 5, 70)
    df = spark.createDataFrame(docs, "text string, lang string")
    assert mined(df, least=5, top=70) == want
    assert mined(df, least=5, top=70, bits=8) == want       # a bit array that says yes to nearly everything


def test_collocation_ties_and_exact_scores(spark):
    docs = [("p q. r s. é z", "en")] * 12 + [("p q", "fr")] * 9
    got = mined(spark.createDataFrame(docs, "text string, lang string"))
    assert got == {"en": [(g, 12, 12, 12, 72, 1_000_000) for g in ("p q", "r s", "é z")]}
    a, left, right = 3_000_000_019, 3_000_000_021, 3_000_000_037
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(left).alias("l"), F.lit(right).alias("r")).select(collocations.score("a", "l", "r")).first()
    assert row[0] == 1_000_000 * a * a // (left * right)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_blocks_hold_each_phrase_once(monkeypatch, k):
    monkeypatch.setattr(collocations, "BLOCK", 40)
    data = (prose(3, 200) + " " + "q" * 300 + " z. " + prose(4, 50) + "   ").encode().translate(collocations._LOWER)
    got = Counter()
    for words in collocations.blocks(data, k):
        got.update(words.texts(words.phrases(k)[0], k).to_pylist())
    want = Counter()
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", data.decode()):
        w = re.findall(r"[^ \t]+", piece)
        want.update(" ".join(w[i:i + k]) for i in range(len(w) - k + 1))
    assert got == want


def test_collocations_on_odd_rows(spark, odd):
    assert mined(odd) == plain_collocations([(t, x) for _, t, x in ODD], 10, 2000)
    assert collocations.mine(odd.limit(0)).count() == 0


# ------------------------------------------------------------------ 12
def plain_search(docs, items, k=10):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    rows = [(d, terms(t)) for d, t in docs]
    held = [(d, x, Counter(x)) for d, x in rows if x]
    n_docs, n_all = len(held), sum(len(x) for _, x, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, x, c in held:
            m = 10 + 90 * len(x) * n_docs // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in set(terms(text)) if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def searched(docs, items, **options):
    return sorted((tuple(r) for r in lexical_search.search(docs, items, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"block_terms": 5}, {"block_pairs": 1}, {"k": 3}])
def test_search_against_plain(spark, options):
    docs = [(i, prose(i, 30 + 5 * i)) for i in range(60)] + [(60, prose(1, 35)), (None, prose(2, 40))]
    items = [(1, "W1 w2, new-york"), (2, "city"), (3, "nothing of it"), (4, None), (5, "w5 w5 w59"), (5, "w5 w5 w59"), (None, "minister")]
    got = searched(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                   spark.createDataFrame(items, "item_id long, text string"), **options)
    assert got == plain_search(docs, items, options.get("k", 10))


def test_search_ties_by_id(spark):
    docs = [(i, "same words here") for i in range(30, 0, -1)] + [(100, "other"), (101, "things")]
    got = searched(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "Same")], "item_id long, text string"))
    assert sorted(r[2] for r in got) == list(range(1, 11))


def test_search_on_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "rivers 漢字 a"), (2, ""), (3, "x" * 70_000), (4, "two")], "item_id long, text string").withColumn("rank", F.lit(0))
    assert searched(odd, items) == plain_search([(d, t) for d, t, _ in ODD], [(r[0], r[1]) for r in items.collect()])
    assert lexical_search.search(odd.limit(0), items).count() == 0 and lexical_search.search(odd, items.limit(0)).count() == 0


# ------------------------------------------------------------------ 13
def plain_measures(text):
    w = re.findall(r"[^ \x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \x09-\x0d]", x)]
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i:i + 8])].append(i)
    repeated = {i + j for at in places.values() if len(at) > 1 for i in at for j in range(8)}
    failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), failed


def plain_quality(docs, labels, threshold):
    """docs: (id, text, group)."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def ngrams(text):
        uni = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) % quality_rules.BUCKETS for w in re.findall(r"[^ \x09-\x0d]+", text or "")]
        return uni + [(a * 31 + b) % quality_rules.BUCKETS for a, b in zip(uni, uni[1:])]

    by = defaultdict(list)
    for d, q, t in labels:
        by[d].append((q or 0) == 1 and not (t or 0))
    trusted = {d for d, ok in by.items() if d is not None and all(ok)}
    raw, target = defaultdict(Counter), defaultdict(Counter)
    for d, text, group in docs:
        raw[group or ""].update(ngrams(text))
        if d in trusted:
            target[group or ""].update(ngrams(text))
    share = {g: sum(target[g].values()) / max(1, sum(c.values())) for g, c in raw.items()}
    memo = {}

    def weight(b):
        if b not in memo:
            c, e = sum(x[b] for x in target.values()), sum(x[b] * share[g] for g, x in raw.items())
            memo[b] = round(math.log((c + 5.0) / (e + 5.0)) * 1_000_000)
        return memo[b]

    out = []
    for d, text, _ in docs:
        own, base = ngrams(text), plain_measures(text)
        total = sum(map(weight, own))
        out.append((d, *base, total / (len(own) * 1e6) if own else None, not base[-1] and bool(own) and total >= threshold * 1e6 * len(own)))
    return out


def near(got, want):
    """Equal, but for the last digits of a score (sums of doubles)."""
    key = lambda r: (str(r[0]), *r[1:6])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [(*r[:-2], r[-1]) for r in got] == [(*r[:-2], r[-1]) for r in want]
    assert [r[-2] for r in got] == [None if r[-2] is None else pytest.approx(r[-2], abs=2e-6) for r in want]


def judged(docs, labels, **options):
    return [tuple(r) for r in quality_rules.quality(docs, labels, group_col="lang", **options).collect()]


def test_quality_against_plain(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()]
    got = catalog.op13_quality_rules(spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    want = plain_quality(docs, labels, quality_rules.THRESHOLD)
    near([tuple(r) for r in got.collect()], want)
    assert 0 < sum(r[-1] for r in want) < len(want)


def test_quality_catches_held_out_junk(spark):
    """Documents whose labels were not shown: bad ones go, good ones stay."""
    sf = SF_SMALL.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    shown = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = quality_rules.quality(docs, labels.where(shown), group_col="lang").where("NOT base_failed").join(labels.where(~shown), "doc_id")
    share = {r["quality"]: r["kept"] for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] >= 0.99 and share[0] <= 0.2


def test_quality_on_odd_rows(spark, odd):
    labels = [(1, 1, None), (5, 1, 0), (5, 0, 0), (None, 1, 0), (9, None, 1), (77, 1, 0), (10, 1, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    near(judged(odd, lab), plain_quality(ODD, labels, quality_rules.THRESHOLD))
    assert {r[-2] for r in judged(odd, lab.limit(0))} == {0.0, None}
    assert judged(odd.limit(0), lab) == []
    quality_rules.BROADCAST_IDS, held = 0, quality_rules.BROADCAST_IDS        # the trusted ids are joined
    try:
        near(judged(odd, lab), plain_quality(ODD, labels, quality_rules.THRESHOLD))
    finally:
        quality_rules.BROADCAST_IDS = held


def test_repeated_words_of_a_long_text(spark):
    rng = np.random.default_rng(1)
    words = [f"t{i}" for i in rng.integers(0, 5000, 60_000)]
    words[30_000:30_010] = words[100:110]
    text = " ".join(words)
    got = quality_rules.measure(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(got[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == plain_measures(text)
    assert got["n_repeat_words"] == 20
