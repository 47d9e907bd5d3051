"""Joins, decontamination, language-model scores, HTML and the pipeline against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weekcell.llm import decontamination, html_blocks, html_extraction, lm_score, ngram_join, pieces, quality, toxicity
from weekcell.llm.components import connected_components


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return Counter((d, len(sets[k]), least.get(find(k)) if sets[k] else d) for k, (d, _) in enumerate(rows))


def near_copies(seed, families=12, size=14):
    draw, rows = random.Random(seed), []
    for _ in range(families):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.choice([3, 6, 9, 12, 20, 40, 90, 200]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(10_000)}"
            if draw.random() < 0.3:
                copy = copy[:max(1, len(copy) - draw.randrange(6))]
            rows.append((len(rows), draw.choice([" ", "\n ", "\t"]).join(copy).upper() if draw.random() < 0.2 else " ".join(copy)))
    return rows


@pytest.mark.parametrize("n,percent", [(5, 80)])
def test_components_against_all_pairs(spark, n, percent):
    rows = near_copies(n) + [(900, None), (901, ""), (902, " \n"), (902, " \n"), (7, "w1 w2 other text here now and then again"), (None, "a b c"), (None, "a b c"), (0, "same id other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("clash"), "root": F.lit(1)})
    got = ngram_join.NgramJoin(docs, n, percent).components().collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, n, percent)


def test_similar_sets_share_a_signature():
    draw = np.random.default_rng(3)
    for trial in range(400):
        percent = int(draw.choice([60, 80, 85, 95]))
        size = int(draw.integers(1, 90))
        a = draw.integers(0, 2 ** 63, size).astype(np.uint64)
        gone = int(draw.integers(0, size + 1)) * (100 - percent) // 100
        b = np.concatenate([a[gone:], draw.integers(0, 2 ** 63, int(draw.integers(0, 1 + size * (100 - percent) // 100))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both) or set(a) == set(b):
            continue
        row, sig = ngram_join.part_signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
        assert set(sig[row == 0]) & set(sig[row == 1]), (percent, len(a), len(b), both)


def test_one_hot_family_and_copies(spark):
    draw = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base)) for k in range(300)]
    for k in range(300, 600):
        copy = list(base)
        copy[draw.randrange(60)] = f"y{k}"
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.NgramJoin(docs, 5, 80).components().collect()
    assert {r.component_id for r in got} == {0} and len(got) == 600


def test_one_of_each_group_keeps_one_row(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (3, "other words stand here alone", "z"), (4, None, "n"), (4, None, "n"),
            (None, "null id text that is alone", "q"), (1, "the same id again with another text", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __extra string")
    got = ngram_join.one_of_each_group(docs)
    assert got.columns == docs.columns
    assert Counter(tuple(r) for r in got.collect()) == Counter([rows[0], *rows[3:]])
    assert ngram_join.one_of_each_group(docs.limit(0)).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(200, 200), (300, 299)]
    got = {r.u: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 150)}, 299: 299, 300: 299}


# ---- decontamination

def test_items_against_brute_force(spark):
    draw = random.Random(9)
    items = [(k, " ".join(f"i{draw.randrange(10_000)}" for _ in range(draw.choice([1, 3, 5, 6, 9, 14, 30, 59, 150])))) for k in range(40)] + [(77, None), (78, ""), (5, "repeated id of an item that is here")]
    rows = []
    for k in range(150):
        words = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([5, 60, 400, 6000]))]
        for _ in range(draw.choice([0, 0, 1, 2])):
            item = draw.choice(items)[1] or ""
            part = item.split()
            part = part[:max(1, len(part) * draw.choice([10, 9, 8, 7, 5]) // 10)]
            at = draw.randrange(len(words))
            words[at:at] = part
        rows.append((k, " ".join(words)))
    rows += [(3, None), (3, ""), (None, items[8][1]), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in decontamination.contained_items(
        docs, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))).collect()}
    want = set()
    for d, t in rows:
        held = shingle_set(t, 5)
        for i, text in items:
            own = shingle_set(text, 5)
            if own and 100 * len(own & held) >= 80 * len(own):
                want.add((d, i, len(own), len(own & held)))
    assert got == want and len(want) > 20
    clean = decontamination.without_items(docs, spark.createDataFrame(items, "item_id long, text string"))
    bad = {(d, t) for d, t in rows if any(100 * len(shingle_set(x, 5) & shingle_set(t, 5)) >= 80 * len(shingle_set(x, 5)) for _, x in items if shingle_set(x, 5))}
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(x for x in rows if x not in bad)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contained_items(docs, nothing).collect() == [] and decontamination.without_items(docs, nothing).count() == len(rows)
    assert decontamination.contained_items(docs.limit(0), nothing).collect() == []


def test_minima_are_taken_of_blocks_with_an_items_shingle(monkeypatch):
    """The same keys as without the filter of shingles, from the few blocks that hold one."""
    from types import SimpleNamespace
    draw = random.Random(4)
    item = [f"i{k}" for k in range(40)]
    words = [[f"w{draw.randrange(10 ** 6)}" for _ in range(400)] for _ in range(60)]
    words[7][100:100], words[30][:0] = item, item[:35]
    docs = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([" ".join(w) for w in words[:-1]] + [None])], ["doc_id", "text"])
    known = next(decontamination._items(5)(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(item)])], ["item_id", "text"])])))
    every = np.full(decontamination.SIGNATURE_BITS // 8, 255, np.uint8)

    def bits(column):
        out = np.zeros(decontamination.SIGNATURE_BITS, np.uint8)
        out[decontamination._slots(np.asarray(known.column(column).flatten()).view(np.uint64))] = 1
        return np.packbits(out, bitorder="little")

    def keys(held):
        run = decontamination._document_keys(5, [6], SimpleNamespace(value=(bits("keys"), held)))
        wanted = set(known.column("keys").flatten().to_pylist())
        return {x for r in run(iter([docs])) for x in zip(*(c.to_pylist() for c in r.columns)) if x[0] in wanted}
    seen, minima = [], decontamination.block_minima

    def watched(*args):
        out = minima(*args)
        seen.append(len(out[0]))
        return out
    monkeypatch.setattr(decontamination, "block_minima", watched)
    assert keys(bits("items")) == keys(every) and len({doc for _, _, doc in keys(every)}) == 2
    assert seen[0] < 20 < 300 < seen[1]


# ---- language model

@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_brute_force(spark, order):
    draw = random.Random(order)
    rows = [(k, " ".join(f"w{min(draw.randrange(60), draw.randrange(60))}" for _ in range(draw.choice([0, 1, 2, 30, 300])))) for k in range(60)]
    rows += [(None, None), (3, "W1 w1\tw1"), (3, "W1 w1\tw1"), (9, "only once " + "w1 " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"block": F.lit("clash"), "part": F.lit(1)})
    words = [(t or "").lower().split() for _, t in rows]
    count = Counter(tuple(w[k - n:k]) for w in words for n in range(1, order + 1) for k in range(n, len(w) + 1))
    total = sum(map(len, words))
    want = []
    for (d, _), w in zip(rows, words):
        score, bare = 0.0, 0
        for k in range(len(w)):
            for n in range(min(order, k + 1), 0, -1):
                gram = tuple(w[k + 1 - n:k + 1])
                if n == 1:
                    score, bare = score + math.log(count[gram] / total), bare + 1
                elif count[gram] >= 2:
                    score += math.log(count[gram] / count[gram[:-1]])
                    break
                else:
                    score += math.log(0.4)
        want.append((d is None, d or 0, len(w), bare, round(score, 6)))
    for size in [2000] if order < 3 else [1 << 23]:  # many blocks, one block
        got = lm_score.score_documents(docs, order=order, block_bytes=size).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_bare, round(r.log_score, 6)) for r in got) == sorted(want)
    assert lm_score.score_documents(docs.limit(0)).collect() == []


# ---- HTML

def test_blocks_of_untidy_markup():
    page = ("<!DOCTYPE html><head><title>t</title><script>var x='</p>';</script></head><body class='Main-Page'><!-- <p>no</p> -->"
            "<p>one<br>two &amp; <b>three<p title='a>b'>four\n\n five&nbsp;six<ul><li>x<li><a href=/>y</a> z</ul><p>open &copy; 1 < 2")
    got = html_blocks.blocks(page)
    assert [b.text for b in got] == ["one two & three", "four five six", "x", "y z", "open © 1 < 2"]
    assert got[0].path == (("body", "main", "page"), ("p",)) and [b.path[-1][0] for b in got] == ["p", "p", "li", "li", "p"]
    assert got[3].linked == 1
    assert html_blocks.blocks("") == [] and html_blocks.blocks("<style>p{}") == [] and html_blocks.blocks("plain") [0].text == "plain"
    assert html_blocks.blocks("<" * 3000)[0].text == "<" * 3000


@pytest.mark.parametrize("page, want", [
    ('<article><p>a</p><svg class="i"/><p>long rest', ["a", "long rest"]), ("<p>a<math/> b", ["a b"]),
    ("<head><title>x</title><p>whole article</p>", ["whole article"]), ("<html><head><meta charset=u><script>s</script>text", ["text"]),
    ("<head><title>x</title></head><p>a", ["a"]), ("<head><template><div>no</div></template><link><div>a</div>", ["a"]),
    ("<div><svg><path></div><p>a", ["a"]), ("<p><span><svg><path d=1></span> a", ["a"]), ("<div><object><p>no</div>a", ["a"]),
    ("<div><template><div>no</div>no</div>a", ["a"]), ("<div><math><mi>no</mi></div>a", ["a"]), ("<svg><g><p>a", ["a"]),
    ("<svg><svg></svg>no</svg>a", ["a"]), ("<svg><foreignObject><div>no</div></foreignObject>no</svg>a", ["a"]),
    ("<svg><style/><path/></svg><p>a", ["a"]), ("<svg><title>no</title></svg>a<script>'<p>no'</script>b", ["ab"]), ("<object>no</object>a", ["a"])])
def test_blocks_around_hidden_tags(page, want):
    assert [b.text for b in html_blocks.blocks(page)] == want


@pytest.fixture(scope="module")
def labeller(spark):
    return html_extraction.fit_labeller(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_labeller_finds_articles(spark, labeller, folder):
    got = html_extraction.extract(spark.read.parquet(f"{folder}/pages.parquet"), labeller).collect()
    right = 0
    for r in got:
        page = html_blocks.blocks(r.html)
        right += r.main_text == "\n\n".join(b.text for b in page if any(e[0] == "article" for e in b.path))
    assert right >= len(got) - 1


def test_labeller_in_layouts_it_has_not_seen(labeller):
    draw, wrong, total = random.Random(1234), 0, 0
    texts = [" ".join(f"word{draw.randrange(900)}" for _ in range(80)) + "." for _ in range(50)]
    for _ in range(150):
        page, labels = html_extraction._made_up(draw, texts)
        p = html_extraction.probabilities(labeller, [html_extraction.features(html_blocks.blocks(page))])[0]
        wrong, total = wrong + int(((p >= 0.5) != (np.array(labels) >= 0.5)).sum()), total + len(labels)
    assert wrong < 0.05 * total


def test_states_do_not_depend_on_the_batch(labeller):
    draw = np.random.default_rng(1)
    pages = [draw.normal(size=(n, html_extraction.INPUT)).astype(np.float32) for n in (1, 7, 30)]
    together = html_extraction.probabilities(labeller, pages)
    for page, p in zip(pages, together):
        assert np.allclose(html_extraction.probabilities(labeller, [page])[0], p, atol=1e-5)


def test_odd_pages(spark, labeller):
    rows = [(1, None, None), (1, None, None), (2, "u", ""), (None, "u", "<p>"), (3, "u", "<article>" + "<p>some words of a long page.</p>" * 20_000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"main_text": F.lit(1), "text": F.lit("clash")})
    got = {r.page_id: r.main_text for r in html_extraction.extract(pages, labeller).collect()}
    assert got[1] == got[2] == got[None] == "" and len(got[3]) > 400_000
    assert html_extraction.extract(pages.limit(0), labeller).collect() == []
    assert html_extraction.fit_labeller(pages.filter("page_id < 3")) is None
    assert {r.main_text for r in html_extraction.extract(pages, None).collect()} == {""}


# ---- pipeline

def test_pipeline_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("extra", F.lit("x"))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding"]
    calm = stages["toxicity"](spark, docs, folder)
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(toxicity.training_rows(docs, labels)))
    assert {r.doc_id for r in calm.collect()} == {r.doc_id for r in scored.filter("toxicity < 0.5").collect()} and calm.columns == docs.columns
    good = stages["quality rules"](spark, calm, folder)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.judge(calm).filter("kept").collect()}
    single = stages["n-gram Jaccard join"](spark, good, folder)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in single.collect()} == {c for _, _, c in brute_components(rows, 5, 80)}
    clean = stages["benchmark decontamination"](spark, single, folder)
    items = [shingle_set(r.text, 5) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = {r.doc_id for r in single.collect() if not any(x and 100 * len(x & shingle_set(r.text, 5)) >= 80 * len(x) for x in items)}
    assert {r.doc_id for r in clean.collect()} == want and clean.columns == docs.columns
    out = stages["SentencePiece encoding"](spark, clean, folder)
    texts = {r.doc_id: r.text for r in clean.collect()}
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(list(r.ids) == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in out.collect())
    assert out.count() == len(texts)


def test_stages_take_odd_tables(spark, folder):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x " * 50_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("toxicity", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "SentencePiece encoding":
            assert out.columns == docs.columns
        assert out.count() <= len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == []


def test_sketches_differ_in_no_more_bits_than_the_sets(spark):
    draw, rows = np.random.default_rng(8), []
    for trial in range(120):
        size = int(draw.choice([1, 5, 31, 33, 64, 65, 300, 1000]))
        a = np.unique(draw.integers(0, 2 ** 63, size).astype(np.uint64))
        gone = int(draw.integers(0, len(a) // 3 + 1))
        b = np.unique(np.concatenate([a[gone:], draw.integers(0, 2 ** 63, int(draw.integers(0, len(a) // 2 + 2))).astype(np.uint64)]))
        words, bounds = ngram_join.parity_sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        both = len(np.intersect1d(a, b))
        for percent in (40, 60, 80, 85, 95):
            rows.append((trial, percent, (len(a), words[:bounds[1]].tolist()), (len(b), words[bounds[1]:].tolist()), 100 * both >= percent * (len(a) + len(b) - both)))
    side = "struct<n_shingles: bigint, sketch: array<bigint>>"
    pairs = spark.createDataFrame(rows, f"trial int, percent int, a {side}, b {side}, linked boolean")
    docs = spark.createDataFrame([], "doc_id long, text string")
    for percent in (40, 60, 80, 85, 95):
        close = ngram_join.NgramJoin(docs, 5, percent)._close("a", "b")
        got = pairs.filter(F.col("percent") == percent).select("linked", close.alias("close")).collect()
        assert all(r.close for r in got if r.linked)
        assert percent < 80 or sum(r.close for r in got) <= sum(r.linked for r in got) + 12


def test_hints_tell_texts_with_one_passage_apart(spark):
    """Texts that share a passage meet in signatures; before, each such meeting became a pair that was joined with both sketches."""
    draw, percent = random.Random(8), 80
    passage, rows = " ".join(f"p{k}" for k in range(60)), []
    for k in range(40):
        own = " ".join(f"w{draw.randrange(10 ** 6)}" for _ in range(draw.choice([60, 90, 150])))
        rows.append((k, f"{passage} {own}"))
    rows += [(100 + k, t) for k, (_, t) in enumerate(near_copies(5, families=20, size=4))]
    base = ngram_join.NgramJoin(spark.createDataFrame(rows, "doc_id long, text string"), 5, percent).base.select(
        "doc_id", *ngram_join.hints(F.col("n_shingles"), F.col("sketch"))).filter("h1 <> 0")
    pairs = (base.alias("a").join(base.alias("b"), F.col("a.doc_id") < F.col("b.doc_id"))
             .select(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v"), ngram_join.may_link("a.", "b.", percent).alias("open")))
    sets = {d: shingle_set(t, 5) for d, t in rows}
    apart = opened = 0
    for u, v, is_open in pairs.collect():
        both = len(sets[u] & sets[v])
        if 100 * both >= percent * (len(sets[u]) + len(sets[v]) - both):
            assert is_open, (u, v)
        elif u < 100 and v < 100:
            apart, opened = apart + 1, opened + is_open
    assert apart == 780 and opened < 80


def test_signatures_of_a_large_batch_come_in_small_pieces():
    """A worker holds the signatures of about 1 MB of text at once (before: of 4 MB), and they are the same."""
    draw = random.Random(11)
    texts = [" ".join(str(draw.randrange(10 ** 6)) for _ in range(500)) for _ in range(1000)]  # 3.4 MB
    parts = list(ngram_join._signatures(5, 80)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])))
    assert max(p.nbytes for p in parts) < 2 << 20
    values, rows, fp = ngram_join.set_rows(pa.array(texts), 0, len(texts), 5)
    owner, sig = ngram_join.part_signatures(values, rows, 80)
    want = sorted(zip(sig.view(np.int64).tolist(), fp[owner].view(np.int64).tolist()))
    assert sorted((s, f) for p in parts for s, f in zip(p.column(0).to_pylist(), p.column(1).to_pylist())) == want
