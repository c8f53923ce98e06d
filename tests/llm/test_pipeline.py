"""The pipeline's stages, one by one and together."""

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from flowsentry.llm import chosen_path, decontaminate, lang_id, pii
from flowsentry.llm.catalog import tokenizer_path
from flowsentry.llm.common import Scratch
from tests.conftest import SF_SMALL


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "benchmark_decontamination", "private_data", "token_ids"]


def test_run_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = lang_id.fit(docs)
    kept = {d: t for d, t in rows.items() if model.predict(t, {})[0] != "und" and model.predict(t, {})[1] >= 0.5}
    sets = {d: set(chosen_path.shingles(t).tolist()) for d, t in kept.items()}
    ids = sorted(kept)
    root = {d: d for d in ids}
    changed = True
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    kept = {d: t for d, t in kept.items() if root[d] == d}
    grams = set()
    for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect():
        w = r["text"].split()
        grams |= {tuple(w[i:i + 8]) for i in range(len(w) - 7)}
    clean = {d for d, t in kept.items() if not any(tuple(t.split()[i:i + 8]) in grams for i in range(len(t.split()) - 7))}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    assert set(out) <= clean and len(clean - set(out)) <= 0.01 * len(clean)       # templates also see words across marks
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(corpus_pipeline.MODEL))
    for d, r in out.items():
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"])
        if not pii.find(kept[d]):
            assert r["ids"] == sp.encode(kept[d])
        else:
            assert sp.decode(r["ids"]) != kept[d]


def test_stages_on_odd_rows(spark):
    rows = [(1, "Mr. Bob Smith lives here, call 743-555-3824 now please.", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0),
            (None, "words that stand without any id at all", "en", None, None), (4, "12 34", "en", "a", 5), (4, "12 34", "en", "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("lang_pred", F.lit("clash")).withColumn("row", F.lit(1))
    scratch = Scratch(spark, "t")
    docs = scratch.table(df, "docs")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.table(stage(spark, docs, SF_SMALL), name)
        assert out.dtypes == df.dtypes
        docs = out
    assert {r["doc_id"] for r in docs.collect()} == {1, None}
    assert corpus_pipeline.token_ids(spark, docs, SF_SMALL).count() == 2
    empty = scratch.table(df.limit(0), "empty")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_SMALL).count() == 0
    assert decontaminate.WIDTH == 8


def test_near_dedup_keeps_one_of_each_group_in_a_node_that_stays_large(spark):
    """One template below the threshold with planted pairs: the rows that stay
    are those of all pairs, whatever the size of their node."""
    from tests.llm.test_operators import plain_near, varied, words
    base, rows = words("template", 200), []
    for i in range(150):
        text = varied(f"t{i}", base, 5)
        rows.append((2 * i, text))
        rows.append((2 * i + 1, varied(f"p{i}", text.split(" "), 1) if i % 2 else varied(f"o{i}", base, 6)))
    _, roots = plain_near(rows)
    out = chosen_path.dedup(spark.createDataFrame(rows, "doc_id long, text string"), leaf=4, depth=1, block=16)
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted({rows[r][0] for r in roots})
