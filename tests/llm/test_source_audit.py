"""Source audit against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weekcell.llm import source_audit

TERMS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans(source_audit.UPPER, source_audit.LOWER)


def brute(rows, least, top=10):
    """Counter of (lang, source, part, item, value, rank) for rows of (text, lang, source)."""
    documents, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = [t.translate(LOWER) for t in TERMS.findall(text or "")]
        documents[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = Counter()
    for lang, sources in groups.items():
        kept = [t for t, n in documents[lang].items() if n >= least]

        def level(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10 ** 9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}
        p = {s: level(counts[lang, s]) for s in sources}
        q = level(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out.update((lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(ranked))
    return out


def made(seed, size=160):
    draw = random.Random(seed)
    forms = ["{}", "{},", "({})", "{}!", "x-{}", "{}-{}", "A{}", "9{}9", "é{}"]
    out = []
    for _ in range(size):
        words = []
        for _ in range(draw.choice([0, 1, 5, 30])):
            w = f"{chr(97 + draw.randrange(3))}{chr(97 + draw.randrange(6))}"
            words.append(draw.choice(forms).format(*[draw.choice([w, w.upper(), w.title()])] * 2))
        out.append((draw.choice([" ", "\n", "\t "]).join(words), draw.choice(["en", "en", "fr", None, "Ä"]), f"s{draw.randrange(5)}"))
    return out


def audited(spark, rows, least):
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns(
        {"chunk": F.lit(1), "term": F.lit("x"), "row": F.lit(None).cast("int"), "docs": F.lit("y"), "n": F.lit(0)})
    return Counter(tuple(r) for r in source_audit.audit(docs, least).collect())


@pytest.mark.parametrize("least", [1, 4, 10])
def test_audit_against_counting(spark, least):
    """Few documents a term: most terms are open by the bounds of their chunks, and are decided by looking documents up."""
    rows = made(least)
    assert audited(spark, rows, least) == brute(rows, least)


def test_small_tiles_blocks_and_flushes(spark, monkeypatch):
    rows = made(23)
    monkeypatch.setattr(source_audit, "TILE_SOURCES", 2)
    monkeypatch.setattr(source_audit, "BLOCK_TERMS", 16)
    monkeypatch.setattr(source_audit, "HELD_CHUNKS", 7)
    monkeypatch.setattr(source_audit, "BATCH_ROWS", 3)
    assert audited(spark, rows, 3) == brute(rows, 3)


def test_any_rows(spark):
    """Nulls, repeated rows, sources without terms, ties in value, languages with one source, a text of 12 MB, an empty table."""
    rows = [(None, None, None), (None, "en", None), ("", "en", "b"), ("42 -- !", "en", "c"), ("one two", "en", "a"), ("one two", "en", "a"),
            ("two one", "en", "d"), ("Zwei", "de", "a"), (" x y", "en", "a"), ("tie tie", "fr", "p"), ("tie tie", "fr", "q"), ("tie", "fr", "r"),
            ("one, " * 2_400_000, "en", "b")]
    assert audited(spark, rows, 2) == brute(rows, 2)
    assert audited(spark, rows[:4], 1) == brute(rows[:4], 1)
    assert audited(spark, [], 1) == Counter()


def test_query_against_counting(spark, folder):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in source_audit.op12_source_audit(spark, folder).collect()) == brute(rows, 10)


def test_terms_of_chunks_are_counted_where_they_lie(spark):
    """Short and long chunks give what a plain count gives; the terms of short ones are not dealt out (before, every chunk was dealt three times to be cut)."""
    chunks = ["a,B;a-c", "--", "x" * 70, ",".join(["p", "q", "P"] * 40), "é1É1é"]
    docs = spark.createDataFrame([(" ".join(chunks), lang, "s") for lang in ("l", "l", "m")], "text string, lang string, source string")
    want = Counter()
    for lang, n in (("l", 2), ("m", 1)):
        for c in chunks:
            for term, times in Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in c))).items():
                want[lang, c, term, times, n] += 1
    held, writes = source_audit.written, {}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(source_audit, "written", lambda df, name, **o: writes.setdefault(name, df) and held(df, name, **o))
        got = Counter((r.lang, r.chunk, r.term, r.times, r.docs) for r in source_audit.factorized(docs).collect())
    assert got == want
    plan = writes["factors"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


def test_occurrences_come_once_for_each_chunk_of_a_piece(spark):
    """A piece of text gives one row for each chunk, with its sources as a list (before: one row for each chunk and source), and exact sums."""
    import numpy as np
    import pyarrow as pa

    class Full:
        value = np.full(source_audit.FILTER_BITS // 8, 255, np.uint8)

    class Empty:
        value = np.zeros(source_audit.FILTER_BITS // 8, np.uint8)
    texts = [" a\tb a ", "b", "", "a\x0bc\x1cd", "a"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["x", "x", "x", "x", "y"]), pa.array(["s", "t", "t", "t", "s"]), pa.array(range(5))], ["text", "lang", "source", "row"])
    out = [r for b in source_audit._second_look(Full, Empty)(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["lang"], r["chunk"], sorted(zip(r["sources"], r["n"]))) for r in out) == [
        ("x", "a", [("s", 2), ("t", 1)]), ("x", "b", [("s", 1), ("t", 1)]), ("x", "c\x1cd", [("t", 1)]), ("y", "a", [("s", 1)])]
    every = [r for b in source_audit._second_look(Empty, Full)(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["lang"], r["chunk"], r["row"]) for r in every) == [("x", "a", 0), ("x", "a", 3), ("x", "b", 0), ("x", "b", 1), ("x", "c\x1cd", 3), ("y", "a", 4)]
