"""Token files and pieces against the libraries themselves."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from weekcell.llm import pieces, token_files

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = "ab e▁ \n\t\0é日本語😀  x<0A>.thinǵΣΑς'sÅ̇\x1c\x85\xa0"


def odd_texts(n, longest=60):
    draw = random.Random(7)
    return ["".join(draw.choice(ODD) for _ in range(draw.randint(0, longest))) for _ in range(n)] + [
        *(" " * k for k in range(20)), *("a" + " " * k + "b" for k in range(40)), "the" * 300, "",
        "<s> </s> <unk> <|endoftext|><|startoftext|>x"]


@pytest.fixture(scope="module")
def corpus(spark, folder):
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    return texts + odd_texts(1500)


def test_pieces_are_the_librarys(corpus):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own, memo = pieces._table(PIECES)
    for text in corpus:
        ids = library.encode(text)
        assert pieces.encode(text, PIECES) == ids
        assert own.decode(ids) == library.decode(ids)
        found = [memo[p] for p in own.cut(text)]
        assert ",".join(x[1] for x in found) == ",".join(map(str, ids))
        assert "".join(x[2] for x in found)[1:] == library.decode(ids)


def test_decode_of_broken_bytes():
    own, _ = pieces._table(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    draw = random.Random(3)
    for _ in range(300):
        ids = [draw.choice([own.byte_ids[draw.randrange(256)], draw.randrange(259, 32000)]) for _ in range(draw.randint(1, 8))]
        assert own.decode(ids) == library.decode(ids), ids


def test_memo_stays_bounded():
    from weekcell.llm.memo import Memo

    memo = Memo(str.upper, limit=2000, longest=3)
    for k in range(500):
        assert memo[f"{k:03d}"] == f"{k:03d}"
        assert memo["long" * 5] == "LONG" * 5
    assert len(memo) < 20 and "long" * 5 not in memo


def test_words_are_the_librarys(corpus):
    library, own = Tokenizer.from_file(WORDS), token_files.WordEncoder(WORDS)
    for text in corpus:
        ids = np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert own.encode(text.encode()) == ids, text


def test_words_with_accents_and_marks_are_the_librarys():
    """Also with the memo turning over: a word in use is then not encoded again (before, a full memo forgot all words at once)."""
    draw = random.Random(4)
    library, own = Tokenizer.from_file(WORDS), token_files.WordEncoder(WORDS)
    own.words.limit, calls, letters = 40_000, Counter(), own._letters
    own._letters = lambda word: calls.update([word]) or letters(word)
    parts = ["été", "ÉTÉ", "Über", "straße", "ÿ", "Þorn", "×", "÷", "ab", "Zq", "'", "'s", "…", "!!", ",", "_", "7", "\x00", "\x1c", "|", "\u00a0", "e\u0301", "İ", "Σ", "ſ"]
    for turn in range(1500):
        text = " ".join("".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(3)) + " house house, garden"
        text += " " + "".join(draw.choices("abcdefgh", k=9))
        assert own.encode(text.encode()) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text
    assert own.words.former and calls["house"] == calls["garden"] == 1


def test_blocks_round_trip():
    draw = np.random.default_rng(5)
    for _ in range(200):
        ids = draw.integers(0, 2 ** int(draw.integers(1, 33)), int(draw.integers(1, 1025)), dtype=np.uint64).astype("<u4")
        if draw.random() < 0.3:
            ids[:] = ids[0]
        if draw.random() < 0.3:
            ids[draw.integers(0, len(ids))] = 2 ** 32 - 1
        assert (token_files.unpack_block(b"xyz" + token_files.pack_block(ids), 3) == ids).all()
    ids = draw.integers(0, 49408, 5000).astype("<u4")
    starts, payload = token_files.pack(ids)
    assert (token_files.unpack(starts, payload) == ids).all()
    assert (token_files.unpack(starts, payload, 2, 4) == ids[2048:4096]).all()


def test_query_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    library, at = Tokenizer.from_file(WORDS), 0
    got = {r.doc_id: r for r in token_files.op7_token_files(spark, folder).collect()}
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [2]
        want = (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == want
        at += len(ids)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in pieces.op8_pieces(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").collect():
        ids = model.encode(r.text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(model.decode(ids).encode()).hexdigest())


def test_odd_rows(spark, tmp_path):
    """Null and empty texts, null and repeated ids, clashing extra columns, an empty table."""
    rows = [(3, None, "x", 1), (3, None, "x", 1), (None, "a b", "y", 2), (1, "", None, 3), (2, "word " * 200_000, "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, start long")
    token_files.write_token_table(docs, str(tmp_path / "t"), WORDS, end_id=2)
    got = [(r.doc_id, r.start, r.n_tokens) for r in token_files.read_documents(spark, str(tmp_path / "t")).orderBy("start").collect()]
    assert got == [(None, 0, 3), (1, 3, 1), (2, 4, 200_001), (3, 200_005, 1), (3, 200_006, 1)]
    token_files.write_token_table(docs.limit(0), str(tmp_path / "e"), WORDS, end_id=2)
    assert token_files.read_documents(spark, str(tmp_path / "e")).collect() == []
    n = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in pieces.piece_digests(docs, PIECES).collect())
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert n == [(False, 1, 0), (False, 2, len(library.encode("word " * 200_000))), (False, 3, 0), (False, 3, 0), (True, 0, 2)]
    assert pieces.with_ids(docs, PIECES).filter("doc_id = 1").collect()[0].ids == []
    assert pieces.piece_digests(docs.limit(0), PIECES).collect() == []


def test_pairs_by_history_are_pairs_by_merging():
    own, _ = pieces._table(PIECES)
    draw = random.Random(11)
    tokens = list(own.ids.values())
    short = [k for k in tokens if len(own.text[k]) < 4]
    spaces = [k for k in tokens if set(own.text[k]) == {pieces.SPACE}]
    pairs = [(draw.choice(tokens), draw.choice(tokens)) for _ in range(20_000)]
    pairs += [(draw.choice(short), draw.choice(short)) for _ in range(20_000)] + [(a, b) for a in spaces for b in spaces + short[:200]]
    for word in ("thing", "unhappiness", "aaaaaaa", "abababab", "enenenen", "ß", "ionsion"):
        near = [k for k in tokens if own.text[k].strip(pieces.SPACE) in word]
        pairs += [(a, b) for a in near for b in near]
    wrong = 0
    for a, b in pairs:
        if own.origins[a] is pieces._ODD or own.origins[b] is pieces._ODD:
            continue
        apart = own._merge(own.text[a] + own.text[b]) == [own.text[a], own.text[b]]
        wrong += own._compatible((a, b)) != apart
    assert wrong == 0
    assert sum(own.origins[k] is pieces._ODD for k in tokens) < len(tokens) // 20


def test_ids_are_remembered_alone():
    """A worker that only needs ids holds bytes of ids for a piece (before: their digits and the decoded text as well)."""
    import pyarrow as pa

    texts = ["one two three", "", None, "trois  four"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["__text"])
    out = [x for b in pieces._encoded(PIECES)(iter([batch])) for x in b.column("ids").to_pylist()]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert out == [library.encode(t or "") for t in texts]
    _, memo = pieces._ids(PIECES)
    assert memo and all(isinstance(v, bytes) for v in memo.values())
