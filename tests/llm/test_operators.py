"""The training-data operators on small tables: against plain versions, and
with nulls, empty and long texts, ties, repeated rows, empty tables and
further columns with clashing names."""

import itertools
import os
import random
import weakref

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowsentry.llm import (catalog, chat_format, chosen_path, decontaminate, embedding_dedup, lang_id, line_dedup, pii,
                            sentence_pieces, token_counts, url_filter)
from flowsentry.llm.common import Scratch, components, local_roots, run_hash, run_hashes, tidy

PROSE = "the quick brown fox jumps over the lazy dog while seven old wizards mix fresh herbs in a copper pot near that river".split()


def words(seed, n):
    rng = random.Random(seed)
    return [rng.choice(PROSE) + rng.choice(["", "s", "ed", "ing", "ly"]) for _ in range(n)]


def sentences(seed, n):
    return " ".join(" ".join(words(f"{seed}-{i}", 9)).capitalize() + "." for i in range(n))


# columns that the operators make themselves, to clash with
EXTRA = ["row", "id", "n_tokens", "score", "lang_pred", "component", "h", "entities", "pos"]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every odd case."""
    long = " ".join(words(7, 30_000))
    rows = [(1, "A plain text about rivers and dogs."), (2, None), (3, ""), (4, "  \n\t "), (5, long), (6, "Hi."), (6, "Hi."),
            (7, "12 !! 34 %%"), (None, "A text without an id but with words in it."), (8, "x" * 5000), (9, "Ünïcödé 漢字 😀 текст"),
            (10, "a\u0301 İK １２ \x00 \x1c ok")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string"))
    for c in EXTRA:
        df = df.withColumn(c, F.lit("clash"))
    return df.coalesce(2)


# ------------------------------------------------------------------ shared
def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(20)]
    got = {r["node"]: r["root"] for r in components(Scratch(spark, "t"), spark.createDataFrame(pairs, "a long, b long")).collect()}
    roots = local_roots(400, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got == {n: int(roots[n]) for a, b in pairs if a != b for n in (a, b)}


def test_local_roots_of_nothing():
    assert local_roots(3, np.array([], int), np.array([], int)).tolist() == [0, 1, 2]


# ------------------------------------------------------------------ 1
def plain_passages(docs, min_words):
    """(id, start, end) by a dictionary."""
    first, out = {}, []
    for d, t in docs:
        for no, (a, b, norm, n) in enumerate(line_dedup.units(t or "")):
            first.setdefault(norm, (d, no))
    for d, t in docs:
        run = []
        for no, (a, b, norm, n) in [*enumerate(line_dedup.units(t or "")), (-9, (0, 0, None, 0))]:
            if run and (norm is None or first[norm] == (d, no) or no != run[-1][0] + 1):
                if sum(x[3] for x in run) >= min_words:
                    out.append((d, run[0][1], run[-1][2]))
                run = []
            if norm is not None and first[norm] != (d, no):
                run.append((no, a, b, n))
    return sorted(out)


def test_line_dedup_against_dictionary(spark):
    shared = [sentences(f"p{i}", 7) for i in range(3)]
    docs = [(i, "\n".join([sentences(i, 3), shared[i % 3] if i % 2 else sentences(f"u{i}", 4), "All rights reserved.", sentences(-i - 1, 2)]))
            for i in range(40)]
    docs[5] = (5, docs[1][1].upper().replace(" ", "  "))       # the same words, other case and space
    got = line_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = got.collect()
    assert sorted((r["doc_id"], r["start"], r["end"]) for r in rows) == plain_passages(docs, line_dedup.MIN_WORDS)
    assert {r["doc_id"] for r in rows} <= {i for i in range(40) if i % 2}
    assert all(set(r["kept_in"]) <= {0, 1, 3, 11} for r in rows)


def test_line_dedup_mid_line_passage(spark):
    p = sentences("p", 8)
    docs = [(1, f"Some start words here {p} and an end"), (2, f"other begin {p} other close")]
    rows = line_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["kept_in"]) for r in rows] == [(2, [1])]


def test_line_dedup_odd_rows(spark, odd):
    assert line_dedup.repeated_passages(odd).columns == ["row", "doc_id", "start", "end", "n_words", "n_units", "kept_in"]
    twice = odd.unionByName(odd.where("doc_id = 5"))
    assert [(r["doc_id"], r["kept_in"]) for r in line_dedup.repeated_passages(twice).collect()] == [(5, [5])]
    assert line_dedup.repeated_passages(odd.limit(0)).count() == 0
    path = Scratch(spark, "t")
    table = path.table(twice, "twice")
    out = line_dedup.dedup_lines(table)
    assert out.columns == twice.columns and out.where("doc_id = 5 and text = ''").count() == 1


# ------------------------------------------------------------------ 2
ITEMS = [(1, "Tom has 12 apples and gives 5 apples to his sister Anna before walking 3 km home."), (2, "What is the capital?"),
         (3, "Two"), (4, None), (5, sentences("item", 3))]


def test_leaks_exact_template_and_inconsistent(spark):
    docs = [(1, "intro words " + ITEMS[0][1] + " and more"),
            (2, "Now Bob has 77 apples and gives 8 apples to his sister Mary before walking 9 km home."),
            (3, "Now Bob has 77 apples and gives 77 apples to his sister Mary before walking 9 km home."),     # two values became one
            (4, " ".join(words("x", 200))), (5, ITEMS[4][1].replace(" ", "%%% ")), (6, "so, WHAT is the capital? yes"), (7, None), (8, "")]
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert got[1, 1] == "exact" and got[2, 1] == "template" and got[5, 5] == "exact" and got[6, 2] == "exact"
    assert (3, 1) not in got and not {4, 7, 8} & {d for d, _ in got}


def test_leaks_against_plain_windows(spark):
    """Texts without slots: windows of eight words, by a dictionary."""
    rng = random.Random(3)
    items = [(i, " ".join(words(f"b{i}", 20))) for i in range(6)]
    docs = []
    for i in range(60):
        w = words(f"d{i}", 40)
        if i % 3 == 0:
            src = items[i % 6][1].split()
            a = rng.randrange(0, 10)
            w[10:10] = src[a:a + rng.choice([6, 7, 8, 9, 12])]
        docs.append((i, " ".join(w)))
    grams = {}
    for i, t in items:
        w = t.split()
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k:k + 8]), set()).add(i)
    want = {(d, i) for d, t in docs for k in range(len(t.split()) - 7) for i in grams.get(tuple(t.split()[k:k + 8]), ())}
    args = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(*args).collect()} == want
    bound, decontaminate.BROADCAST_WINDOWS = decontaminate.BROADCAST_WINDOWS, 1     # the way past the bound
    try:
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(*args).collect()} == want
    finally:
        decontaminate.BROADCAST_WINDOWS = bound


def test_template_has_one_word_for_each_value(spark, odd):
    bad = (odd.select(decontaminate.spaced(F.col("text")).alias("s"), "text")
           .select(F.size(F.filter(F.split(F.coalesce(decontaminate.template(F.col("s")), F.lit("")), " "), lambda x: x != "")).alias("a"),
                   F.size(decontaminate.values(F.col("text"))).alias("b")).where("a <> b"))
    assert bad.count() == 0


def test_decontaminate_odd_rows(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert decontaminate.decontaminate(odd, items).count() == odd.count()
    assert decontaminate.leaks(odd.limit(0), items).count() == 0
    assert decontaminate.leaks(odd, items.limit(0)).count() == 0
    mine = spark.createDataFrame([(9, "A text without an id but with words in it.")], "item_id long, text string")
    assert decontaminate.decontaminate(odd, mine).count() == odd.count() - 1


def test_leaks_do_not_hang_on_case_or_what_stands_before(spark):
    items = [(1, "What is the capital of France?"), (2, "Anna and Tom walk 3 km to the market. There they buy bread for Mary.")]
    before = ["", "Question:\n", "Question: ", "# Task 7\n", "so he asked \"", "see (", "one line\n"]
    docs = [(10 * i + j, b + t) for i, b in enumerate(before)
            for j, t in enumerate([x for _, q in items for x in (q, q.lower(), q.upper())])]
    docs += [(900, "Question:\nWhat is the capital of Spain?"), (901, "Question:\nWhat is the river of Spain?"), (902, "what IS the")]
    args = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.leaks(*args).collect()}
    want = {(d, 1 + (d % 10) // 3): "exact" for d, _ in docs[:-3]} | {(900, 1): "template"}
    assert got == want


def test_leaks_beside_a_clash(spark):
    """Long literal runs stand though two equal values of the item differ."""
    head, tail = " ".join(words("head", 20)), " ".join(words("tail", 25))
    items = [(1, f"so Tom has 12 apples {head} and 12 pears {tail}"), (2, "so Tom met Tom and Tom paid 4 of 4 coins")]
    docs = [(1, f"so Tom has 12 apples {head} and 13 pears {tail}"),            # one of two values changed
            (2, f"so Bob has 7 apples {head} and 8 pears {tail}"),              # drawn apart
            (3, "so Tom met Bob and Jim paid 4 of 5 coins"), (4, f"{' '.join(words('a', 20))} and 13 pears {' '.join(words('b', 20))}")]
    args = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["matched_words"] for r in decontaminate.leaks(*args).collect()}
    assert set(got) == {(1, 1), (2, 1)} and got[1, 1] >= 40 and got[2, 1] >= 40


def test_decontaminate_removes_rows_not_ids(spark):
    rows = [(None, ITEMS[0][1]), (None, "clean words without any id here"), (7, "other clean words under one id"), (7, "see: " + ITEMS[4][1]),
            (7, None), (8, "more clean words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash"))
    out = decontaminate.decontaminate(df, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert out.columns == df.columns
    assert sorted(map(str, out.drop("digest").collect())) == sorted(map(str, df.drop("digest").where(
        "text is null or text like '%clean%'").collect()))


def plain_matches(doc, item, width=8):
    """Item places covered by windows that are equal word by word, the first
    place of each window of the item."""
    d, w = doc.split(), item.split()
    n = min(width, len(w))
    first = {}
    for i in range(len(w) - n + 1):
        first.setdefault(tuple(w[i:i + n]), i)
    return {first[tuple(d[j:j + n])] + k for j in range(len(d) - n + 1) if tuple(d[j:j + n]) in first for k in range(n)}


def test_rows_of_numbers(spark):
    """Numbers alone: found where equal, nowhere else, and in good time."""
    rng = random.Random(5)
    item = " ".join(str(rng.randrange(100, 999)) for _ in range(200))
    noise = [str(rng.randrange(100, 999)) for _ in range(5000)]
    docs = [(1, " ".join(noise)), (2, " ".join(noise[:2400] + item.split()[50:90] + noise[2400:])), (3, item), (4, "7 " * 4000), (5, " ".join(noise[:30]))]
    items = [(1, item), (2, "7 " * 200), (3, "1 2 3")]
    args = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["kind"], r["matched_words"]) for r in decontaminate.leaks(*args).collect()}
    want = {(d, i): ("exact", len(c)) for d, t in docs for i, q in items if (c := plain_matches(t, q))}
    assert got == want and set(want) == {(2, 1), (3, 1), (4, 2)}


def test_run_hashes(spark):
    df = spark.createDataFrame([([1, 2, 3, 1, 2, 3, 4, 5, 6, 7],), ([5],), ([],)], "x array<long>")
    rows = run_hashes(df, "x", [2, 3, 5, 7]).collect()
    for k in (2, 3, 5, 7):
        runs = [tuple(rows[0]["x"][i:i + k]) for i in range(11 - k)]
        named = dict(zip(rows[0][f"x_{k}"], runs))
        assert len(rows[0][f"x_{k}"]) == len(runs) and len(named) == len(set(runs))
        assert rows[1][f"x_{k}"] is None and rows[2][f"x_{k}"] is None
        one = df.limit(1).select(run_hash([F.get("x", F.lit(2 + i)) for i in range(k)]).alias("h")).first()["h"]
        assert one == rows[0][f"x_{k}"][2]


# ------------------------------------------------------------------ 3
def plain_links(rows, threshold):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    a, b = [], []
    for i, j in itertools.combinations(range(n), 2):
        if ok[i] and ok[j] and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
            x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                a.append(i)
                b.append(j)
    links = np.bincount(a + b, minlength=n)
    return links, local_roots(n, np.array(a, int), np.array(b, int))


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 8))
    rows = [(i, (base[i % 30] + rng.normal(size=8) * rng.choice([0, .05, .12, .3])).tolist(), int(i % 3)) for i in range(400)]
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, base[0].tolist(), None), (1004, [], 1),
             (1005, [1.0, None], 1), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (1008, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("row", F.lit("clash")).withColumn("v", F.lit(1))
    links, roots = plain_links(rows, 0.98)
    want = {r[0]: (int(links[i]), rows[roots[i]][0]) for i, r in enumerate(rows)}
    for block in (16, 1024):                # many cells and blocks, or one
        old, embedding_dedup.BLOCK = embedding_dedup.BLOCK, block
        embedding_dedup.link_counts.__defaults__ = (block, *embedding_dedup.link_counts.__defaults__[1:])
        try:
            got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.dedup_embeddings(df).collect()}
        finally:
            embedding_dedup.BLOCK = old
            embedding_dedup.link_counts.__defaults__ = (old, *embedding_dedup.link_counts.__defaults__[1:])
        assert got == {k: (n, c, k == c) for k, (n, c) in want.items()}
    assert sum(links) > 100


def test_embeddings_repeats_and_empty(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (None, [1.0, 0.001], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, embedding_dedup.dedup_embeddings(df).collect()), key=str)
    assert got == [(3, 2, 3, True), (3, 2, 3, True), (None, 2, 3, False)]
    assert embedding_dedup.dedup_embeddings(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 4
def test_token_counts_equal_library(spark, odd):
    from tokenizers import Tokenizer
    path = catalog.tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    alphabet = "".join(map(chr, range(1, 256))) + "'sS tΣςéé漢字̃İK１😀"
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) + rng.choice(["", "<|endoftext|>", "<|startoftext|>x"]))
            for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(lib.encode(r["text"] or "", add_special_tokens=False).ids))
                   for r in df.collect()), key=str)
    for head in (token_counts.HEAD_SIZE, 20, 0):        # all in the head, some, none
        got = token_counts.count_tokens(df, path, head_size=head)
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert token_counts.count_tokens(odd, path).columns == ["doc_id", "n_bytes", "n_tokens"]
    assert token_counts.count_tokens(odd.limit(0), path).count() == 0


# ------------------------------------------------------------------ 5
def test_language_id_held_out(spark):
    from tests.conftest import SF_ORACLE
    got = catalog.op5_language_id(spark, SF_ORACLE).join(spark.read.parquet(f"{SF_ORACLE}/documents.parquet"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert right[0] > 0.97 and right[1] > 100


def test_language_id_odd_rows(spark, odd):
    train = spark.createDataFrame([("the dog and the river", "en"), ("der hund und der fluss", "de"), (None, "fr"), ("x", None)], "text string, lang string")
    model = lang_id.fit(train)
    assert model.langs == ["de", "en"]
    out = lang_id.predict(odd, model)
    assert sorted(out.columns) == sorted(odd.columns)
    got = out.groupBy("lang_pred").count().collect()
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect()}
    assert rows[2] == rows[3] == rows[4] == rows[7] == ("und", 0.0) and rows[1][0] == "en" and len(got) >= 2
    assert all(0 <= s <= 1 for _, s in rows.values())
    none = lang_id.fit(train.limit(0))
    assert {r["lang_pred"] for r in lang_id.predict(odd, none).collect()} == {"und"}
    assert lang_id.predict(odd.limit(0), model).count() == 0


def test_language_model_against_plain_counts(spark):
    """Counts of all words and n-grams, those of a text without spaces too."""
    rng = random.Random(6)
    unspaced = ["".join(rng.choice(letters) for _ in range(10_000)) for letters in ("abcdeé", "abcxyz")]
    rows = [(unspaced[0], "aa"), (unspaced[1], "bb"), ("\U00010330\U00010331 Aber ab, ab 12 é", "aa"), ("xy ab", "bb"), (None, "aa"), ("ab", None), ("", "cc")]
    model = lang_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    counts = {"word": {}, "gram": {}}
    for text, lang in rows:
        for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split() if lang else ():
            if len(w) <= lang_id.LONGEST_WORD:
                counts["word"].setdefault(w, {}).setdefault(lang, []).append(1)
            edged = f"<{w}>"
            for g in [*w, *(edged[i:i + n] for n in (2, 3, 4) for i in range(len(edged) - n + 1))]:
                counts["gram"].setdefault(g, {}).setdefault(lang, []).append(1)
    assert model.langs == ["aa", "bb"]
    for kind, names, logp in (("word", model.words, model.word_logp), ("gram", model.grams, np.array(model.gram_logp))):
        assert set(names) == set(counts[kind])
        total = [sum(len(c.get(x, ())) for c in counts[kind].values()) for x in model.langs]
        for key, i in names.items():
            n = [len(counts[kind][key].get(x, ())) for x in model.langs]
            assert logp[i] == pytest.approx([np.log((a + 0.5) / (b + 0.5 * len(names) + 1)) for a, b in zip(n, total)])
    assert len(lang_id.grams_of("a" * 1000, 4)) == 999
    assert [model.predict(t[::-1], {})[0] for t in unspaced] == ["aa", "bb"]
    assert model.predict("c" * 70 + "é" * 500, {})[0] == "aa"          # behind the first letters too


def test_language_tasks_free_what_a_worker_kept(spark, monkeypatch):
    """A worker that encoded before holds no codec while it counts words or
    tells languages; n-gram frequencies are one array, results go in slices."""
    docs = spark.createDataFrame([(i, f"the dog and river {i}", "en" if i % 2 else "de") for i in range(1200)], "doc_id long, text string, lang string")
    model, tasks, plain = lang_id.fit(docs), [], type(docs).mapInArrow
    assert isinstance(model.gram_logp, np.ndarray)
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: tasks.append(run) or plain(df, run, schema))
    lang_id.word_counts(docs.select("text", "lang"))
    lang_id.predict(docs.select("text", "lang"), model)
    batch = pa.RecordBatch.from_pylist([{"text": r["text"], "lang": r["lang"]} for r in docs.collect()])
    for run, most in zip(tasks, (10_000, lang_id.SLICE), strict=True):
        kept = weakref.ref(sentence_pieces.codec(catalog.tokenizer_path("piece_bpe_32k.model")))
        assert kept() is not None
        out = list(run(iter([batch, batch.slice(0, 0)])))
        assert kept() is None
        assert 0 < max(x.num_rows for x in out) <= most
    assert sum(x.num_rows for x in out) == 1200


def test_a_worker_gives_its_memory_back_after_a_task():
    """Small pieces that a task frees below one that stays."""
    def held_mb():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    stays = []

    def run(batches):
        pieces = [bytes(2_000) for _ in range(100_000)]
        stays.append(bytes(2_000))
        yield from batches
        del pieces

    before = held_mb()
    assert list(tidy(run)(iter([1, 2]))) == [1, 2]
    assert held_mb() - before < 60


def test_backoff_takes_the_longest_known_grams():
    m = lang_id.Model(["a", "b"], {"known": 0}, np.log([[.9, .1]]), {"<ab": 0, "x": 1}, np.log([[.2, .8], [.7, .3]]).tolist())
    assert m.backoff("abx") == m.gram_logp[0]      # three characters before one
    assert m.backoff("x") == m.gram_logp[1]
    assert m.backoff("q") is None
    assert m.predict("known", {})[0] == "a" and m.predict("abz", {})[0] == "b"


# ------------------------------------------------------------------ 6
def test_sentencepiece_equals_library(spark, odd):
    import sentencepiece
    path = catalog.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    alphabet = "abcdefghijklmnopqrstuvwxyzABC  \n\t.,!?0123éñß漢字😀\u3000'\"-_"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(80)))) for i in range(400)]
    rows += [(500 + n, "x" + " " * n + "y" * n) for n in range(0, 150, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    out = sentence_pieces.encode(df, path).collect()
    for r, t in zip(out, df.collect()):
        assert r["ids"] == (None if t["text"] is None else sp.encode(t["text"]))
        assert r["round_trip"] == (None if t["text"] is None else True)
    back = sentence_pieces.decode(sentence_pieces.encode(odd, path), path)
    assert sorted((r["doc_id"], r["text"]) for r in back.where("doc_id is not null").collect() if r["text"] is not None) == sorted(
        (r["doc_id"], r["text"]) for r in odd.where("doc_id is not null").collect() if r["text"] is not None)
    assert sentence_pieces.encode(odd.limit(0), path).count() == 0


def test_frequent_segments_stay_when_the_table_is_full(monkeypatch):
    """Rare words don't push a word out that every text has."""
    made, plain = [], sentence_pieces.Codec._segment
    monkeypatch.setattr(sentence_pieces, "MEMO", 40)
    monkeypatch.setattr(sentence_pieces.Codec, "_segment", lambda c, s: made.append(s.strip(" \u2581")) or plain(c, s))
    c = sentence_pieces.Codec(sentence_pieces.Pieces.load(catalog.tokenizer_path("piece_bpe_32k.model")))
    rng = random.Random(3)
    for _ in range(60):
        rare = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(5)]
        c.encode(" ".join(["so", "river", *rare]))
        assert len(c.memo) + len(c.memo.old) <= 40
    assert made.count("river") == 1 and len(made) == 2 + 60 * 5


def test_sentencepiece_tables_of_any_size_give_the_same_ids(monkeypatch):
    """Tables that overflow all the time, groups of a few texts, words in any
    order and longer than the table takes."""
    import sentencepiece
    path = catalog.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(9)
    letters = "aeinrstélщ漢😀 \u2581.,1-"
    texts = ["".join(rng.choices(letters, k=rng.randrange(90))) for _ in range(150)]
    texts += [" ".join(words(i, 20)) for i in range(30)] + [None, "", " ", "\u2581", "in" * 40 + " " + "in" * 24, " " * 99 + "end"]
    want = [[] if x is None else sp.encode(x) for x in texts]
    for memo, steps, pairs, chars in ((350_000, 150_000, 300_000, 1_000_000), (6, 25, 10, 200), (2, 1, 1, 1)):
        for name, n in (("MEMO", memo), ("STEPS", steps), ("PAIRS", pairs), ("GROUP_CHARS", chars)):
            monkeypatch.setattr(sentence_pieces, name, n)
        c = sentence_pieces.Codec(sentence_pieces.Pieces.load(path))
        got = list(c.encoded(iter(texts)))
        assert [x for x, _ in got] == texts and [ids.tolist() for _, ids in got] == want
        assert sum(len(x) for x in c.p.after[:-1]) <= pairs
        assert sum(len(x) for x in (c.p.begin, *c.p._states.values())) <= steps


def test_beginnings_in_common_are_encoded_once(monkeypatch):
    """Of sorted words only what differs from the word before is run; in any
    order the pieces are those of the whole word."""
    chars, plain = [], sentence_pieces.StreamingViterbi._run
    monkeypatch.setattr(sentence_pieces.StreamingViterbi, "_run", lambda v, s, *rest: chars.append(len(s)) or plain(v, s, *rest))
    c = sentence_pieces.Codec(sentence_pieces.Pieces.load(catalog.tokenizer_path("piece_bpe_32k.model")))
    many = [a + b for a in ("interest", "internal", "intern") for b in ("", "ing", "s", "ed", "ly", "isation")]
    random.Random(2).shuffle(many)
    ids = c.encode(" ".join(many))
    assert sum(chars) < 0.6 * sum(len(x) + 1 for x in many)
    found = []
    for x in many:
        c.viterbi.feed("\u2581" + x)
        whole = c.viterbi.finish()
        c.viterbi.path("\u2581" + many[0])
        assert c.viterbi.path("\u2581" + x) == whole
        found += whole
    assert ids == [i for x in found for i in c.p.piece_ids(x)]


def test_viterbi_of_a_unigram_model_against_all_segmentations():
    scores = {"▁": -2.0, "a": -3.0, "b": -3.1, "ab": -4.0, "ba": -4.5, "aba": -5.2, "▁a": -3.5, "bb": -7.0}
    p = sentence_pieces.Pieces(scores, {s: i + 1 for i, s in enumerate(scores)}, sentence_pieces.UNIGRAM)
    back = {i: s for s, i in p.ids.items()}
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 11)))
        s, best = "▁" + text, None
        for cut in range(1 << (len(s) - 1)):
            parts, last = [], 0
            for i in range(1, len(s) + 1):
                if i == len(s) or cut >> (i - 1) & 1:
                    parts.append(s[last:i])
                    last = i
            if all(x in scores for x in parts):
                total = sum(scores[x] for x in parts)
                best = total if best is None or total > best else best
        got = [back[i] for i in sentence_pieces.Codec(p).encode(text)]
        assert "".join(got) == s and abs(sum(scores[x] for x in got) - best) < 1e-9


def test_viterbi_window_is_bounded():
    scores = {"a": -1.0, "aa": -1.5, "b": -1.0, "▁": -1.0}
    v = sentence_pieces.StreamingViterbi(sentence_pieces.Pieces(scores, {s: i + 1 for i, s in enumerate(scores)}, sentence_pieces.UNIGRAM))
    for _ in range(500):
        v.feed("ab" * 8)
        node, open_path = v.live[-1], 0
        while node[2] is not None:
            node, open_path = node[2], open_path + 1
        assert open_path <= 32 and len(v.live) <= 3
    assert "".join(v.finish()) == "ab" * 4000


# ------------------------------------------------------------------ 7
def plain_chats(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, r, x))
    key = lambda z: tuple((v is not None, v if v is not None else 0) for v in z)
    seqs = {c: tuple((r, x) for _, r, x in sorted(ts, key=key)) for c, ts in convs.items()}
    out = {}
    for c, s in seqs.items():
        if not any((len(o) > len(s) and o[:len(s)] == s) or (o == s and d < c) for d, o in seqs.items() if d != c):
            out[c] = (len(s), "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in s))
    return out


def test_chats_against_plain_prefixes(spark):
    rng = random.Random(6)
    rows = []
    for c in range(60):
        n = rng.randrange(1, 5)
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "", None])) for t in range(n)]
    rows += [(100, 0, "user", "hi"), (100, 0, "user", "hi"), (101, None, None, None), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1)).withColumn("conv", F.lit(1))
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat_format.format_chats(df).collect()}
    assert got == plain_chats(rows)
    assert chat_format.format_chats(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 8
def plain_near(rows):
    import re
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    roots = local_roots(len(rows), np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int))
    return [len(s) for s in sets], roots


def varied(seed, w, n):
    rng = random.Random(seed)
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
    return " ".join(w)


def test_near_duplicates_against_all_pairs(spark):
    rows = []
    for g in range(25):
        w = words(f"g{g}", 80)
        rows += [(len(rows) + k, varied(f"{g}-{k}", w, k % 4)) for k in range(6)]
    rows += [(900 + i, t) for i, t in enumerate([None, "", " \n", "one two", "one two", "One TWO", "É é", "é É", "a b c d e", "a b c d e f"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("n", F.lit(0))
    n, roots = plain_near(rows)
    for options in ({}, {"leaf": 4, "depth": 2}):        # whole nodes, or dealt with pivots
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in chosen_path.near_duplicates(df, **options).collect()}
        assert got == {r[0]: (n[i], rows[roots[i]][0]) for i, r in enumerate(rows)}


def test_near_duplicates_in_a_node_that_stays_large(spark):
    """One template, whose copies are alike below the threshold, with planted
    pairs in it, and a group of near copies: a node that is dealt loses no link."""
    base, rows = words("template", 200), []
    for i in range(150):
        text = varied(f"t{i}", base, 5)
        rows.append((2 * i, text))
        rows.append((2 * i + 1, varied(f"p{i}", text.split(" "), 1) if i % 2 else varied(f"o{i}", base, 6)))
    copies = words("copies", 120)
    rows += [(1000 + i, varied(f"c{i}", copies, 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n, roots = plain_near(rows)
    assert len(set(roots.tolist())) > 50
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in chosen_path.near_duplicates(df, leaf=4, depth=1, block=16).collect()}
    assert got == {r[0]: (n[i], rows[roots[i]][0]) for i, r in enumerate(rows)}


def test_near_duplicates_odd_rows(spark, odd):
    table = Scratch(spark, "t").table(odd, "odd")
    out = chosen_path.dedup(table)
    assert out.columns == odd.columns and out.count() == odd.count() - 1     # the repeated row
    assert chosen_path.near_duplicates(odd.limit(0)).count() == 0
    both = odd.where("doc_id = 1").unionByName(odd.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    assert {(r["doc_id"], r["component_id"]) for r in chosen_path.near_duplicates(both).collect()} == {(1, 1), (None, 1)}


def packed_anew(docs, spark):
    """The table read with another packing of its files by every further job,
    as when the number of live cores changes: the scan's place says no more."""
    import itertools as it
    turn = it.count()

    class Moving(type(docs)):
        def __getattribute__(self, name):
            if name in ("select", "withColumn", "mapInArrow"):
                n = next(turn)
                return getattr(docs.repartition(2 + n % 3, F.xxhash64("text", F.lit(n))), name)
            return super().__getattribute__(name)

    docs.__class__ = Moving
    return docs


def test_rows_keep_their_number_when_the_scan_is_packed_anew(spark):
    rows = [(i, varied(f"m{i}", words(f"m{i // 4}", 80), i % 4)) for i in range(60)]
    shared = sentences("moved", 9)
    texts = [(i, f"{t}\n{shared if i % 2 else sentences(f'own{i}', 5)}") for i, t in rows]
    n, roots = plain_near(rows)

    def table(rows):
        return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    out = chosen_path.dedup(packed_anew(table(rows), spark)).collect()
    assert sorted(r["doc_id"] for r in out) == sorted({rows[r][0] for r in roots})
    want = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(Scratch(spark, "t").table(table(texts), "t")).collect()}
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(packed_anew(table(texts), spark)).collect()}
    assert got == want and sum(shared in t for t in got.values()) == 1


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200))).astype(np.uint64) for _ in range(20)]
    got = chosen_path.shared_counts(sets, block=32)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(20) for j in range(20) if i != j)


# ------------------------------------------------------------------ 9
def test_surrogates(spark):
    text = ('Mail jo.doe@mail3.example.com or JO.DOE@MAIL3.EXAMPLE.COM, +1 (743) 555-3824 or 743-555-3824, card 4111 1111 1111 1111, '
            'host 10.0.0.1, token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff". Mrs. Anna Smith met Mr Иван Петров. Smith left.')
    docs = spark.createDataFrame([(1, text), (2, "Call 743-555-3824, Mr. Bob Smith."), (3, None), (4, ""), (5, "version 3.2 of CC BY 4.0")],
                                 "doc_id long, text string").withColumn("entities", F.lit("clash")).withColumn("n_chars", F.lit(1))
    out = {r["doc_id"]: r for r in pii.pseudonymise(docs, "k", keep_entities=True).collect()}
    new = out[1]["text"]
    for gone in ("jo.doe", "JO.DOE", "555-3824", "4111 1111", "10.0.0.1", "24be6443", "Anna", "Smith", "Иван", "Петров"):
        assert gone.lower() not in new.lower()
    e = {x["kind"]: [y["surrogate"] for y in out[1]["entities"] if y["kind"] == x["kind"]] for x in out[1]["entities"]}
    assert e["email"][0].upper() == e["email"][1] and e["email"][0].endswith(".com")
    assert e["phone"][0].startswith("+1 (") and pii.digits_of(e["phone"][0])[1:] == pii.digits_of(e["phone"][1])
    assert pii.luhn(pii.digits_of(e["card"][0])) and len(e["secret"][0]) == 40
    first, last, ru_first, ru_last, again = e["name"]
    assert last == again and first != last and "Ѐ" <= ru_first[0] <= "ӿ" and "Ѐ" <= ru_last[0] <= "ӿ"
    mine = {x["kind"]: x["surrogate"] for x in out[2]["entities"]}
    assert mine["phone"] == e["phone"][1] and [x["surrogate"] for x in out[2]["entities"]][-1] == last
    assert out[3]["text"] is None and out[4]["text"] == "" and out[5]["text"] == "version 3.2 of CC BY 4.0"
    assert pii.pseudonymise(docs, "k").columns == docs.columns
    assert {r["text"] for r in pii.pseudonymise(docs, "other").where("doc_id = 1").collect()} != {new}


def test_surrogates_stay_distinct(spark, monkeypatch):
    """Names of one short stem collide often; none may be shared, nor occur."""
    values = [("name", "s", f"{a}{b}{c}") for a in "bcdfghjk" for b in ("olm", "and", "erk", "ton") for c in ("er", "son", "ley", "man")]
    state = pii.assign(spark.createDataFrame(values, "kind string, gender string, value string"), "k", Scratch(spark, "t")).collect()
    new = [r["new"] for r in state]
    assert len(state) == len(values) == len(set(new)) and not set(new) & {v for _, _, v in values} and max(r["attempt"] for r in state) > 0
    text = "Mr. " + " and Mr. ".join(v.capitalize() for _, _, v in values)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    one = pii.pseudonymise(docs, "k").collect()
    monkeypatch.setattr(pii, "BROADCAST_VALUES", 0)         # the way past the bound
    assert pii.pseudonymise(docs, "k").collect() == one


@pytest.mark.parametrize("number", [
    "+14155551234", "4155551234", "+33 1 23 45 67 89", "01 23 45 67 89", "01.23.45.67.89", "+33 (0)1 23 45 67 89", "0033.1.23.45.67.89", "٠١ ٢٣ ٤٥ ٦٧ ٨٩", "+4915112345678",
    "+1-415-555-1234", "+9 (999) 999-9999", "(743) 555-3824", "٧٤٣-٥٥٥-٣٨٢٤", "+१४१५५५५१२३४", "٤١٥٥٥٥١٢٣٤"])
def test_phone_notations(number):
    for text in (number, f"اتصل: {number}.", f"call {number}, now"):
        found = pii.find(text)
        assert [(e.kind, text[e.start:e.end]) for e in found] == [("phone", number)]
        new = pii.render(found[0], number, pii.surrogate(b"k", "phone", "", found[0].value, 0))
        assert len(new) == len(number) and pii.digits_of(new) != pii.digits_of(number)


def test_cards_in_other_digits_and_no_phones():
    card = "٤١١١ ١١١١ ١١١١ ١١١١"
    assert [(e.kind, e.value) for e in pii.find(card)] == [("card", "4111111111111111")]
    assert not [e for t in ("in 2012 and 1999, 3.14159265358, 12 34", "a4155551234b", "41555512345", "10 20 30 40 50", "+12 and +345") for e in pii.find(t)]


def test_surrogates_odd_rows(spark, odd):
    out = pii.pseudonymise(odd, "k")
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert pii.pseudonymise(odd.limit(0), "k").count() == 0


# ------------------------------------------------------------------ 10
def plain_verdict(url, rules):
    host, path = url_filter.host_and_path(url)
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_against_plain_rules(spark, monkeypatch):
    hosts = ["com", "a.com", "www.a.com", "WWW.A.com", "xa.com", "b.net", "a.com:80", ".com", ""]
    tails = ["", "/", "/en", "/en/", "/en/x?q=/fr/", "#/en/", "?x", "/EN/"]
    urls = [f"{s}{h}{t}" for s in ("http://", "https://", "") for h in hosts for t in tails] + [None, "", "://", "x://y://a.com/en/"]
    rules = [("com", "/", "allow"), ("a.com", "/en/", "block"), ("www.a.com", "/en/", "allow"), ("net", "/", "block"), ("a.com", "/en/x", "allow"),
             ("b.net", "/", "allow"), ("b.net", "/", "block")]
    want = [(i, *plain_verdict(u, rules)) for i, u in enumerate(urls)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("block", F.lit("clash"))
    given = spark.createDataFrame([*rules, (None, "/", "block"), ("x", None, "block")], "host string, path string, verdict string")
    assert sorted(map(tuple, url_filter.judge_urls(df, given).collect())) == want
    assert sorted(map(tuple, url_filter.judge_urls(df, given, max_rules=2).collect())) == want       # the way past the bound
    assert {r["verdict"] for r in url_filter.judge_urls(df, given.limit(0)).collect()} == {"allow"}
    assert url_filter.judge_urls(df.limit(0), given).count() == 0


def test_url_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda k: 7)
    name = url_filter.RuleArray.write([("a.com", "/", "block"), ("b.com", "/", "allow")], str(tmp_path))
    rules = url_filter.RuleArray.open(lambda part: str(tmp_path / f"{name}-{part}.npy"))
    assert rules.judge([("a.com", "/x"), ("b.com", "/"), ("c.com", "/")]) == [("a.com", "/", True), ("b.com", "/", False), None]
