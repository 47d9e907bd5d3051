"""Toxicity, languages and quality: brute-force versions, held-out rows, odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weekcell.llm import languages, quality, toxicity

ODD = [(None, None, None), (None, "", "xx"), (5, "   \n\t ", None), (5, "   \n\t ", None), (6, "12 34 %", "xx"), (7, "é" * 30_000, "yy"),
       (8, "word " * 60_000, "xx"), (9, "a\n\na\nb\r\na b c d e a b c d e", "xx")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumns(
        {"toxicity": F.lit("clash"), "lang_pred": F.lit(1), "lang_score": F.lit("s"), "n_words": F.lit("clash"), "kept": F.lit(3)})


# ---- toxicity

def bags(n, seed):
    draw = random.Random(seed)
    calm = [f"calm{k}" for k in range(200)]
    rows = []
    for k in range(n):
        sentences = [" ".join(draw.choice(calm) for _ in range(draw.randint(3, 9))) for _ in range(draw.randint(1, 12))]
        bad = k % 4 == 0
        if bad:
            sentences.insert(draw.randrange(len(sentences) + 1), f"you {draw.choice(['vile', 'horrid', 'wicked'])}{draw.choice(['ness', 'ly', ''])} calm3")
        rows.append((k, ". ".join(sentences) + ".", int(bad)))
    return rows


def test_toxicity_learns_sentences_from_documents(spark):
    model = toxicity.fit_toxicity(spark.createDataFrame(bags(400, 1), "doc_id long, text string, toxic int"))
    test = spark.createDataFrame(bags(200, 2), "doc_id long, text string, toxic int")
    got = toxicity.score_toxicity(test, model).collect()
    assert np.mean([(r.toxicity >= 0.5) == (r.toxic == 1) for r in got]) > 0.97
    found = toxicity.offending_sentences(test, model).collect()
    texts = {r.doc_id: r.text for r in got}
    spans = [texts[r.doc_id].encode()[r.start:r.start + r.length].decode() for r in found]
    assert len(spans) > 40 and np.mean([bool(re.search("vile|horrid|wicked", s)) for s in spans]) > 0.95


def test_toxicity_of_long_clean_texts(spark):
    """Length alone is no offence, and one vile sentence in a long text still is one."""
    draw = random.Random(3)
    long = [" ".join(f"calm{draw.randrange(100, 200)}" for _ in range(6)) + "." for _ in range(20_000)]  # calm3 stands in vile sentences
    rows = spark.createDataFrame([(1, " ".join(long)), (2, " ".join([*long, "you vile calm3."])), (3, long[0])], "doc_id long, text string")
    sample = spark.createDataFrame(bags(400, 1), "doc_id long, text string, toxic int")
    got = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(rows, toxicity.fit_toxicity(sample)).collect()}
    assert got[1] < 0.5 <= got[2] and math.isclose(got[1], got[3])
    clean = toxicity.fit_toxicity(sample.withColumn("toxic", F.lit(0)))
    assert all(r.toxicity < 0.01 for r in toxicity.score_toxicity(rows, clean).collect())


def test_noisy_or_of_sentences():
    model = toxicity.ToxicityModel(np.sort(np.array([1], np.uint64)), np.array([3.0]), -2.0)
    import pyarrow as pa

    column = pa.array(["one. two! three", "", "no stop"])
    sizes = [n for _, _, n, *_ in toxicity._rows(model.features, column, 0, 3)]
    assert sizes == [3, 0, 1]
    score = next(toxicity._score(model, ["d"])(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), column], ["d", "__text"])])))
    p = 1 / (1 + math.exp(2.0))
    assert np.allclose(score.column("toxicity").to_pylist(), [1 - (1 - p) ** 3, 0.0, p])


def test_toxicity_odd_rows(spark, odd):
    labelled = odd.select("doc_id", "text", F.lit(None).cast("int").alias("toxic"))
    empty = toxicity.fit_toxicity(labelled)
    assert len(empty.features) == 0
    got = toxicity.score_toxicity(odd, empty)
    assert sorted(got.columns) == sorted(odd.columns) and got.count() == len(ODD)
    scores = {(r.doc_id, r.text): r.toxicity for r in got.collect()}
    assert scores[(None, None)] == scores[(None, "")] == 0.0 and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.score_toxicity(odd.limit(0), empty).collect() == []
    assert toxicity.offending_sentences(odd, empty).collect() == []
    only_bad = toxicity.fit_toxicity(odd.select("doc_id", "text", F.lit(1).alias("toxic")))
    assert only_bad.bias > 0


def test_toxicity_keeps_its_fold_out(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = toxicity.training_rows(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert rows.filter("crc32(cast(doc_id AS string)) % 5 = 0").count() == 0 and rows.count() > 0
    got = toxicity.op9_toxicity(spark, folder)
    assert got.count() == docs.count() and got.filter("score < 0 OR score > 1 OR predicted <> cast(score >= 0.5 AS int)").count() == 0


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = (toxicity.op9_toxicity(spark, folder).filter("held_out")
           .join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas())
    assert (got.predicted == got.toxic).mean() > 0.9 and got[got.toxic == 0].predicted.mean() < 0.05


# ---- languages

def test_languages_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = languages.op5_languages(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").toPandas()
    assert len(got) == 1000 and (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_many_languages_share_one_table(spark):
    """Seventy languages need two words of bits; each has its own letters."""
    rows = [(f"l{k:02d}", " ".join(chr(97 + (k + j) % 26) + chr(97 + (3 * k + j) % 26) + chr(0x400 + k) + chr(0x400 + k) for j in range(5))) for k in range(70)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    filters = languages.fit_languages(docs)
    assert filters.table.shape == (languages.ROWS, 2) and filters.languages == sorted(r[0] for r in rows)
    got = languages.identify(docs, filters).collect()
    assert all(r.lang == r.lang_pred for r in got)


def test_language_ngrams_come_from_distinct_words(monkeypatch):
    """Counts against n-grams of whole texts, while a word that comes again is looked at once."""
    texts = ["ab ab, x1y ab\t\u00c9t\u00e9\nab. " * 50, None, "", "ab", "a", "K\u212ak \U0001f600 99", "longer words than five"]
    want: dict[bytes, int] = {}
    for text in texts:
        plain = b" " + bytes(x if x >= 128 or 97 <= x <= 122 else 32 for x in (text or "").lower().encode()) + b" "
        for g in {plain[k:k + n] for n in languages.GRAMS for k in range(len(plain) - n + 1) if 32 not in plain[k + 1:k + n - 1]}:
            want[g] = want.get(g, 0) + 1
    looked_at, grams = [], languages._grams
    monkeypatch.setattr(languages, "_grams", lambda words: looked_at.append(len(words)) or grams(words))
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["xx"] * len(texts))], ["text", "lang"])
    got = pa.Table.from_batches(list(languages._count(["xx"])(iter([batch]))))
    hashes = {int(languages.mix(np.array([int.from_bytes(g, "little")], np.uint64) + np.uint64(len(g)))[0]): n for g, n in want.items()}
    assert {x & (1 << 64) - 1: n for x, n in zip(got["gram"].to_pylist(), got["documents"].to_pylist())} == hashes
    assert sum(looked_at) == len({w for t in texts for w in (t or "").split()} | {""})


def test_languages_return_no_text(spark, odd):
    filters = languages.fit_languages(odd)
    got = languages.identify(odd, filters, keep=["doc_id"])
    assert got.columns == ["doc_id", "lang_pred", "lang_score"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("MapInArrow")[1].split("\n")[0].count("text#") <= 1  # the one that is read; none comes back
    assert sorted(map(str, got.collect())) == sorted(map(str, languages.identify(odd, filters).select(*got.columns).collect()))


def test_languages_odd_rows(spark, odd):
    filters = languages.fit_languages(odd)
    got = languages.identify(odd, filters)
    assert sorted(got.columns) == sorted(odd.columns)
    for r in got.collect():
        blank = not r.text or not re.search(r"[^\W\d_]", r.text)
        assert (r.lang_pred == "und" and r.lang_score == 0) if blank else r.lang_pred in ("xx", "yy")
    nothing = languages.fit_languages(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in languages.identify(odd, nothing).collect()} == {"und"}
    assert languages.identify(odd.limit(0), filters).collect() == []


# ---- quality

def counts(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    windows = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    inside = {p for k in range(len(w) - 4) if windows[tuple(w[k:k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside),
            len(w) < 10 or 100 * len(inside) > 20 * len(w))


def distance(p, q):
    total = sum(a * math.log2(2 * a / (a + b)) for a, b in zip(p, q) if a > 0) + sum(b * math.log2(2 * b / (a + b)) for a, b in zip(p, q) if b > 0)
    return math.sqrt(max(0.0, total / 2))


def test_quality_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r.doc_id: r for r in quality.op10_quality(spark, folder).collect()}
    import unicodedata

    def classes(text):
        kind = Counter("space" if c in quality.SPACES else {"Lu": "upper", "Nd": "digit"}.get(unicodedata.category(c), {
            "P": "mark", "S": "symbol"}.get(unicodedata.category(c)[0], "letter")) for c in text)
        return [kind[c] for c in quality.CLASSES]

    # references come from the distinct texts that pass the base rules
    good = {(d.lang, d.text) for d in docs if d.lang is not None and not counts(d.text)[5]}
    shares, words = {}, {}
    for lang in {lang for lang, _ in good}:
        own = [text for x, text in good if x == lang]
        shares[lang] = np.sum([classes(text) for text in own], axis=0) / sum(map(len, own))
        held = Counter(w.lower() for text in own for w in re.split(r"[\x20\x09-\x0D]+", text) if w)
        top = sorted(held.items(), key=lambda x: (-x[1], x[0]))[:quality.COMMON_WORDS]
        words[lang] = {w: n / sum(n for _, n in top) for w, n in top}
    vocabulary = sorted({w for x in words.values() for w in x})
    for d in docs:
        r, want = got[d.doc_id], counts(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        by_class = min(distance([c / len(d.text) for c in classes(d.text)], s) for s in shares.values()) if d.text else None
        found = Counter(w.lower() for w in re.split(r"[\x20\x09-\x0D]+", d.text or "") if w.lower() in set(vocabulary))
        total = sum(found.values())
        by_word = min(distance([found[w] / total for w in vocabulary], [q.get(w, 0.0) for w in vocabulary]) for q in words.values()) if total else 1.0
        assert math.isclose(r.class_distance, by_class, abs_tol=1e-7) and math.isclose(r.word_distance, by_word, abs_tol=1e-7)
        far = (want[0] >= quality.LEAST_WORDS and by_word > quality.MAX_WORD_DISTANCE) or (
            len(d.text) >= quality.LEAST_CHARS and by_class > quality.MAX_CLASS_DISTANCE)
        assert r.kept == (not want[5] and not far)


def test_quality_is_native(spark, folder):
    plan = quality.op10_quality(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_odd_rows(spark, odd):
    got = quality.judge(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, *r[1:7]) for r in got) == sorted((d is None, d or 0, *counts(t)) for d, t, _ in ODD)
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert quality.judge(odd.limit(0)).collect() == []
    alone = odd.withColumn("lang", F.lit(None).cast("string"))
    assert all(r.kept == (not r.base_failed) for r in quality.judge(alone).collect())


def test_references_leave_out_failed_documents_and_copies(spark, folder):
    """Neither junk that fails the base rules nor copies of a passing text move a distance of the other documents."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    names = " ".join(f"zq{k}x" for k in range(64))
    once = [(10_000, " ".join(f"pass{k}" for k in range(70)), "en")]
    junk = [(20_000 + k, " ".join([names] * 20), "en") for k in range(100)]
    copies = [(30_000 + k, *once[0][1:]) for k in range(100)]
    plain = docs.union(spark.createDataFrame(once, docs.schema))
    want = {(r.doc_id, r.word_distance, r.class_distance, r.kept) for r in quality.judge(plain).collect()}
    got = quality.judge(plain.union(spark.createDataFrame(junk + copies, docs.schema))).collect()
    assert {(r.doc_id, r.word_distance, r.class_distance, r.kept) for r in got if r.doc_id < 20_000} == want
    assert sum(r.base_failed for r in got if 20_000 <= r.doc_id < 30_000) == 100
    good = {(d.lang, d.text) for d in plain.collect() if d.lang and not counts(d.text)[5]}
    held = Counter((lang, w.lower()) for lang, text in good for w in re.split(r"[\x20\x09-\x0D]+", text) if w)
    based = quality._based(plain)
    for lang in {x for x, _ in good}:
        top = sorted(((w, n) for (x, w), n in held.items() if x == lang), key=lambda x: (-x[1], x[0]))[:quality.COMMON_WORDS]
        total = sum(n for _, n in top)
        found = {w: s for x, w, s in quality.word_reference(based, quality.distinct_texts(based)) if x == lang}
        assert found.keys() == {w for w, _ in top} and all(math.isclose(found[w], n / total) for w, n in top)


def test_quality_of_rare_languages(spark, folder):
    """One clean document of a language is kept; a language without a passing document has no distance."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    rare = [(50_001, " ".join(f"слово{k}" for k in range(90)), "ru"), (50_002, "gåte " * 90, "no")]
    got = {r.doc_id: r for r in quality.judge(docs.union(spark.createDataFrame(rare, docs.schema))).collect()}
    assert got[50_001].kept and got[50_001].class_distance < 1e-6
    assert got[50_002].base_failed and got[50_002].word_distance is None and got[50_002].class_distance is None
