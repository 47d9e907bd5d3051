"""License scans against trying every template on every block."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weekcell.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans(licenses.UPPER, licenses.LOWER)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, texts, phrases, percent):
    """Number of words, places of phrases and (label, start, found, size) of blocks that meet a template."""
    w = words(text)
    width = max([len(words(t)) for _, t in texts], default=1)
    places = [(i, label) for label, p in phrases for i in range(len(w)) if w[i:i + len(words(p))] == words(p)]
    met = []
    for start in range(0, max(1, len(w) - width), width):
        block = set(w[start:start + 2 * width])
        for label, t in texts:
            tokens = set(words(t))
            if tokens and 100 * len(tokens & block) >= percent * len(tokens):
                met.append((label, start, len(tokens & block), len(tokens)))
    return len(w), sorted(places), sorted(met)


def columns_of(text):
    n, places, met = brute(text, licenses.TEMPLATES, licenses.PHRASES, licenses.PERCENT)
    base = {x for _, x in places}
    return (n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)),
            ",".join(sorted(base | {m[0] for m in met})), 1.0 if places else max([m[2] / m[3] for m in met], default=0.0))


def scanned(spark, texts_in, texts, phrases, percent):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts_in)], "doc_id int, text string").withColumns(
        {c: F.lit("clash") for c in ("row", "rid", "words", "blocks", "places", "matches", "start")})
    found = licenses.scan(docs, ("doc_id", "words"), texts, phrases, percent).collect()
    assert all(r.row.words == "clash" for r in found)
    return Counter((r.row.doc_id, r.n_words, tuple(sorted(map(tuple, r.places))), tuple(map(tuple, r.matches))) for r in found)


@pytest.mark.parametrize("percent", [1, 50, 70, 90, 100])
def test_scan_against_every_block(spark, percent):
    draw = random.Random(percent)
    letters = [f"t{k}" for k in range(30)]
    texts = [(f"l{k % 5}", " ".join(draw.choice(letters) for _ in range(draw.choice([1, 2, 5, 12, 20])))) for k in range(9)] + [("empty", " -- ")]
    phrases = [("one", "t1"), ("twice", "t2 t2"), ("three", "t1 t2, t3"), ("none", "...")]
    docs = []
    for _ in range(120):
        parts = []
        for _ in range(draw.choice([0, 1, 3, 9])):
            near = draw.choice(texts)[1].split()
            near = [w for w in near if draw.random() < 0.9] if draw.random() < 0.7 else [draw.choice(letters) for _ in range(15)]
            parts += near + [f"x{draw.randrange(5)}" for _ in range(draw.randrange(6))]
        docs.append(draw.choice([" ", "\n", ", "]).join(w.upper() if draw.random() < 0.1 else w for w in parts))
    want = Counter((k, n, tuple(places), tuple(met)) for k, t in enumerate(docs)
                   for n, places, met in [brute(t, texts, [p for p in phrases if words(p[1])], percent)])
    assert scanned(spark, docs, texts, phrases, percent) == want


def test_any_rows(spark):
    """Nulls, blanks, letters that only look lower-case beyond ASCII, ties, repeated rows, no templates, a text of 12 MB, an empty table."""
    long = "Ähm, K " * 1_700_000 + "released UNDER the MIT-License"
    docs = [None, "", " ,.- ", "under the mit license", "under the mit license under the MIT license", "under the mıt license", "x\x00mit"]
    texts, phrases = [("a", "the mit license"), ("b", "license mit the")], licenses.PHRASES
    want = Counter((k, n, tuple(p), tuple(m)) for k, t in enumerate(docs) for n, p, m in [brute(t, texts, phrases, 100)])
    assert scanned(spark, docs, texts, phrases, 100) == want
    assert scanned(spark, docs, [], [], 90) == Counter((k, len(words(t)), (), ()) for k, t in enumerate(docs))
    rows = [(3, "CC BY NC"), (3, "CC BY NC"), (None, "cc by nc 4.0 licensed under"), (4, long), (5, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in licenses.digest(licenses.scan(table)).collect())
    n = len(words(long))
    want = Counter((d, *columns_of(t)) for d, t in rows if t is not long)
    want[(4, n, 1, n - 4, n - 4, "mit", "mit", 1.0)] = 1
    assert got == want
    assert licenses.digest(licenses.scan(table.filter("false"))).collect() == []
    with pytest.raises(ValueError):
        licenses.scan(table, percent=0)


def test_whole_templates_are_found(spark):
    docs = [(k, "Some words before.\n" + t.upper() + "\nand after") for k, (_, t) in enumerate(licenses.TEMPLATES)]
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    for k, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in got[k].labels.split(",") and got[k].score == 1.0


def test_query_against_every_block(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = Counter(tuple(r) for r in licenses.op13_licenses(spark, folder).collect())
    assert got == Counter((d.doc_id, *columns_of(d.text)) for d in docs)


def test_no_python_in_the_plan(spark, folder):
    plan = licenses.op13_licenses(spark, folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
