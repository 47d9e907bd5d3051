"""Runs, transforms and the collapsed text against plain loops over words."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from weekcell.llm import exact_ntt, periodic_runs

SPACES = " \t\n\x0b\f\r"


def words(text):
    return [w for w in "".join(" " if c in SPACES else c for c in text or "").split(" ") if w]


def brute_runs(w):
    """Every maximal stretch of each period; a stretch inside one of a smaller period has that smaller period."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= 4 * q and not any(a <= i and b >= j + q for a, b, _ in found):
                found.append((i, j + q, q))
            i = max(j, i + 1)
    return sorted((a, b - a, q) for a, b, q in found if b - a >= 6)


def brute_collapsed(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]


def noisy(draw, size, letters):
    w = []
    while len(w) < size:
        unit = [f"w{draw.randrange(letters)}" for _ in range(draw.randrange(1, draw.choice([3, 9, 40])))]
        w += unit * draw.choice([1, 1, 2, 4, 5, 9])
    return w[:max(0, size - draw.randrange(3))]


@pytest.mark.parametrize("length", [1, 2, 8, 64, 4096])
def test_transform_there_and_back(length):
    draw = np.random.default_rng(length)
    x = draw.integers(0, exact_ntt.PRIME, (length, 3)).astype(np.uint64)
    assert (exact_ntt.inverse(exact_ntt.transform(x)) == x).all()
    top = np.full((length, 1), exact_ntt.PRIME - 1, dtype=np.uint64)
    assert (exact_ntt.inverse(exact_ntt.transform(top)) == top).all()
    if length <= 64:
        y = draw.integers(0, exact_ntt.PRIME, (length, 3)).astype(np.uint64)
        got = exact_ntt.inverse(exact_ntt.product(exact_ntt.transform(x), exact_ntt.transform(y)))
        for c in range(3):
            want = [sum(int(x[i, c]) * int(y[(k - i) % length, c]) for i in range(length)) % exact_ntt.PRIME for k in range(length)]
            assert got[:, c].tolist() == want


def test_runs_against_loops():
    draw = random.Random(7)
    for _ in range(400):
        docs = [noisy(draw, draw.choice([0, 1, 6, 25, 80, 260]), draw.choice([1, 2, 3, 6])) for _ in range(draw.randrange(1, 5))]
        seen = [{} for _ in docs]
        numbers = [[s.setdefault(w, len(s)) for w in d] for s, d in zip(seen, docs)]
        offsets = np.cumsum([0] + [len(d) for d in docs])
        start, end, period = periodic_runs.runs_of(np.array(sum(numbers, []), dtype=np.int32), offsets)
        want = [(o + s, o + s + n, q) for o, d in zip(offsets, docs) for s, n, q in brute_runs(d)]
        assert list(zip(start.tolist(), end.tolist(), period.tolist())) == want


def test_sums_that_only_vanish_modulo_the_prime_are_no_match(monkeypatch):
    """With a tiny prime in the place of the real one most sums vanish by chance; the runs stay the same."""
    draw = random.Random(3)
    numbers = [draw.randrange(50) for _ in range(300)] + [1, 2, 3, 4, 5] * 9
    true = periodic_runs._matches

    def sloppy(x, blocks, ends, size):
        block, shift = true(x, blocks, ends, size)
        more = [(b, d) for b in range(len(blocks)) for d in range(size, 2 * size) if (b * 7 + d) % 3 and blocks[b] + size + d <= ends[b]]
        both = sorted(set(zip(block.tolist(), shift.tolist())) | set(more))
        return np.array([b for b, _ in both], dtype=np.int64), np.array([d for _, d in both], dtype=np.int64)

    seen = {}
    ids = np.array([seen.setdefault(v, len(seen)) for v in numbers], dtype=np.int32)
    want = [v.tolist() for v in periodic_runs.runs_of(ids, np.array([0, len(ids)]))]
    monkeypatch.setattr(periodic_runs, "_matches", sloppy)
    assert [v.tolist() for v in periodic_runs.runs_of(ids, np.array([0, len(ids)]))] == want


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def test_query_against_loops(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r.doc_id: r for r in periodic_runs.op11_runs(spark, folder).collect()}
    assert len(got) == len(docs)
    for d in docs:
        w = planted(d.doc_id, words(d.text))
        runs, r = brute_runs(w), got[d.doc_id]
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(top or (None,) * 3))
        assert r.exponent_milli == (1000 * top[1] // top[2] if top else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(brute_collapsed(w, runs)).encode()).hexdigest()


def test_any_rows(spark):
    """Nulls, blanks, repeated rows, characters beyond ASCII, columns named like the operator's own, and a text of 12 MB."""
    long = "pre " + "é\tb\n c c " * 1_200_000
    rows = [(1, None, 5), (2, "", 5), (2, " \n\t ", 5), (3, "a a a a a", 0), (3, "a a a a a a", 0), (3, "a a a a a a", 0), (None, "x y " * 4, 1),
            (4, "           ", 1), (5, long, 1)]
    docs = spark.createDataFrame([(a, b, c, "z", "z") for a, b, c in rows], "doc_id long, text string, row int, runs string, collapsed string")
    got = sorted(((r.row.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.row.row) for r in periodic_runs.find_runs(docs).collect()), key=str)
    want = []
    for doc_id, text, c in rows:
        w = words(text)
        runs = brute_runs(w) if len(w) < 100 else [(1, 3 * 1_200_000, 3)]
        left = brute_collapsed(w, runs) if len(w) < 100 else w[:4]
        want.append((doc_id, len(w), runs, " ".join(left), c))
    assert got == sorted(want, key=str)
    short = docs.filter("doc_id = 3")
    assert sorted(r.text for r in periodic_runs.without_repeats(short).collect()) == ["a", "a", "a a a a a"]
    assert periodic_runs.without_repeats(short).columns == docs.columns
    assert periodic_runs.digest(periodic_runs.find_runs(docs.filter("false"))).collect() == []
