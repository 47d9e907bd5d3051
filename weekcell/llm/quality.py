"""Quality by distribution divergence, in DataFrame expressions only.

A document's character classes and its common words are compared with references of each language in the corpus; the distance is
Jensen-Shannon's (the square root of the divergence in bits, 0 to 1). The nearest language counts. A document is
rejected when a distance is above its limit and the document is long enough for that histogram to mean something.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekcell.llm.components import written
from weekcell.llm.registry import query, table

#: Characters that part words, and those that count as symbols.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
_SPLIT, _NOT_SPACE = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"

#: Most frequent words of a language that its reference holds.
COMMON_WORDS = 64
#: Distinct texts that a language needs for a reference: any makes one.
LEAST_DOCUMENTS = 1
#: Limits of the two distances, and how many words or characters a document needs to be judged by them.
MAX_WORD_DISTANCE = 0.78
LEAST_WORDS = 60
MAX_CLASS_DISTANCE = 0.25
LEAST_CHARS = 300
CLASSES = ("upper", "digit", "mark", "symbol", "space", "letter")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside the lambdas that ``body`` makes."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text: none for a null or blank one."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPLIT))


def _covered(hashes: Column) -> Column:
    """How many words lie in 5-word windows whose hash occurs twice or more."""
    def of_sorted(pairs: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(pairs, i - 1)["k"] == x["k"]).otherwise(False)
            return before | F.coalesce(F.get(pairs, i + 1)["k"] == x["k"], F.lit(False))
        places = F.sort_array(F.transform(F.filter(pairs, twin), lambda x: x["p"]))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(5)), F.lit(5))), F.lit(0), lambda a, x: a + x))

    pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("k"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, of_sorted))


def _windows(words: Column) -> Column:
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) < 5, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))))


def _rest(text: Column) -> Column:
    """A text without plain letters and spaces."""
    return F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", "")


def _kept(pattern: str) -> Column:
    """Characters of a class, counted in what is left of the text without plain letters and spaces."""
    return F.char_length(F.regexp_replace(F.col("__rest"), f"[^{pattern}]+", "")).cast("long")


def _classes() -> dict[str, Column]:
    return {"__upper": _kept(r"\p{Lu}"), "__digit": _kept(r"\p{Nd}"), "__mark": _kept(r"\p{P}"), "__symbol": _kept(r"\p{S}")}


def _others() -> dict[str, Column]:
    return {"__space": F.col("__chars") - F.col("word_chars"),
            "__letter": F.col("word_chars") - F.col("__upper") - F.col("__digit") - F.col("__mark") - F.col("__symbol")}


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang) with __words, the base counts and the counts of character classes.

    A null text has no words and no lines. Lines that hold no word are never repeated lines.
    """
    text = F.coalesce(F.col("__text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_NOT_SPACE))
    return (docs.withColumns({"__words": words_of(F.col("__text")), "__rest": _rest(text)})
            .withColumns({
                "n_words": F.size("__words").cast("long"),
                "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
                "n_symbols": _kept(r"#*$%&|<>"),
                "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
                "n_repeat_words": let(_windows(F.col("__words")), _covered).cast("long"),
                **_classes(), "__chars": F.char_length(text).cast("long")})
            .withColumns({
                "base_failed": (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words")),
                **_others()}))


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the text as ``__text``, and the whole row as ``__row``, so that no column of ``docs`` can clash."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").cast("long").alias("doc_id"),
                       lang.alias("lang"), F.col("text").cast("string").alias("__text"))


def _based(docs: DataFrame) -> DataFrame:
    """Of ``docs``: the rows of ``with_base`` without their text (``__row`` holds it) as a written table, so that the verdict of the base
    rules is computed once; with a row number and a hash of the text."""
    rows = (with_base(prepared(docs)).withColumns({"__key": F.xxhash64("__text"), "__id": F.monotonically_increasing_id()})
            .drop("__words", "__rest", "__text"))
    return written(rows, "based", compression="zstd")


def _text(based: DataFrame) -> DataFrame:
    return based.withColumn("__text", F.col("__row")["text"].cast("string"))


def distinct_texts(based: DataFrame) -> DataFrame:
    """Of each language the documents that pass the base rules, a row for each distinct text: least row number and character counts.

    Texts are known by a 64-bit hash. Folded before they are dealt, so a group of copies is no task of its own.
    """
    return (based.filter(~F.col("base_failed") & F.col("lang").isNotNull()).groupBy("lang", "__key")
            .agg(*[F.min(c).alias(c) for c in ("__id", "__chars", *[f"__{c}" for c in CLASSES])]))


def word_reference(based: DataFrame, texts: DataFrame) -> list[tuple[str, str, float]]:
    """(language, word, share) of each language's most common words, from each distinct text that passes the base rules once.

    ``texts`` are the ``distinct_texts`` of ``based``. Words are lower-cased; ties go to the first in order. Comes to the driver:
    COMMON_WORDS rows a language. The numbers of further copies are written, so that their size says whether they can be broadcast
    to the texts.
    """
    good = based.filter(~F.col("base_failed") & F.col("lang").isNotNull())
    copies = written(good.select("__id").join(texts.select("__id"), "__id", "left_anti"), "copies")
    counts = (_text(good.join(copies, "__id", "left_anti")).select("lang", F.explode(words_of(F.lower("__text"))).alias("word"))
              .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    top = (counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
           .filter(F.col("r") <= COMMON_WORDS))
    held = top.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    return [(r.lang, r.word, r.share) for r in held.select("lang", "word", "share").collect()]


def class_reference(texts: DataFrame) -> list[tuple[str, list[float]]]:
    """(language, shares of CLASSES) over ``distinct_texts``."""
    sums = (texts.groupBy("lang")
            .agg(F.count(F.lit(1)).alias("docs"), F.sum("__chars").alias("chars"), *[F.sum(f"__{c}").alias(c) for c in CLASSES])
            .filter(F.col("docs") >= LEAST_DOCUMENTS))
    return [(r.lang, [r[c] / r.chars for c in CLASSES]) for r in sums.collect()]


def _half(p: Column, q: Column) -> Column:
    """p * log2(2p / (p + q)), 0 for p = 0."""
    return F.when(p > 0, p * F.log2(F.lit(2.0) * p / (p + q))).otherwise(F.lit(0.0))


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), divergence / F.lit(2.0)))


def class_distance(reference: list[tuple[str, list[float]]]) -> Column:
    """Distance of a row's character classes to the nearest language (null without any reference)."""
    def to(shares: list[float]) -> Column:
        terms = []
        for c, share in zip(CLASSES, shares):
            p, q = F.col(f"__{c}") / F.col("__chars"), F.lit(float(share))
            terms += [_half(p, q), _half(q, p)]
        total = terms[0]
        for x in terms[1:]:
            total = total + x
        return _distance(total)
    if not reference:
        return F.lit(None).cast("double")
    return F.when(F.col("__chars") > 0, F.array_min(F.array(*[to(s) for _, s in reference])))


def with_word_distance(based: DataFrame, reference: list[tuple[str, str, float]]) -> DataFrame:
    """Rows with ``word_distance``: common-word histogram (and the rest of the words as one class) to the nearest language.

    Every row counts its common words in place; (word, count) pairs meet the reference, and one sum for each language
    and row goes back to the row, so that no word is shuffled.
    """
    languages = sorted({lang for lang, _, _ in reference})
    if not languages:
        return based.withColumn("word_distance", F.lit(None).cast("double"))
    share = {(lang, word): s for lang, word, s in reference}
    vocabulary = sorted({word for _, word, _ in reference})
    # one array of shares for each word, found by its place among the sorted words
    places = F.create_map(*[x for k, w in enumerate(vocabulary) for x in (F.lit(w), F.lit(k))])
    shares = F.array(*[F.array(*[F.lit(float(share.get((lang, w), 0.0))) for lang in languages]) for w in vocabulary])
    common = F.sort_array(F.filter(F.transform("__words", lambda w: F.lower(w)), lambda w: w.isin(vocabulary)))

    def runs(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1),
                          lambda i: (i == 0) | (F.get(x, i) != F.get(x, F.greatest(i - 1, F.lit(0)))))
        return let(starts, lambda s: F.transform(s, lambda at, i: F.struct(
            F.get(x, at).alias("w"), (F.coalesce(F.get(s, i + 1), F.size(x)) - at).alias("n"))))

    def divergences(pairs: Column, total: Column) -> Column:
        """Per language: sums over the words present, and what the reference holds of the others."""
        def add(acc: Column, pair: Column) -> Column:
            def with_share(p: Column, q: Column) -> Column:
                """A word that the language doesn't have adds p * log2(2)."""
                return F.zip_with(acc, q, lambda a, b: F.struct(
                    (a["s"] + F.when(b > 0, _half(p, b) + _half(b, p)).otherwise(p)).alias("s"), (a["seen"] + b).alias("seen")))
            return let(pair["n"] / total, lambda p: let(F.get(shares, F.element_at(places, pair["w"])), lambda q: with_share(p, q)))
        zero = F.array(*[F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("seen")) for _ in languages])
        return F.aggregate(pairs, zero, add, lambda acc: F.array_min(F.transform(
            acc, lambda a: _distance(a["s"] + F.greatest(F.lit(0.0), F.lit(1.0) - a["seen"])))))

    return based.withColumn("__common", let(common, lambda x: F.when(F.size(x) > 0, runs(x)).otherwise(
        F.array().cast("array<struct<w:string,n:int>>")))).withColumn(
        "word_distance", F.when(F.size("__common") == 0, F.lit(1.0)).otherwise(let(
            F.aggregate(F.col("__common"), F.lit(0), lambda a, x: a + x["n"]), lambda total: divergences(F.col("__common"), total))))


def judged(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (as ``__row``) with doc_id, the base counts, base_failed, the two distances and ``kept``.

    References come from those of ``docs`` that pass the base rules. A document is kept if it passes the base rules and each histogram that it is
    long enough for is near some language. Where a document names a language without reference (no document of it passes the base
    rules), or the corpus has none, the distances are null and only the base rules decide.
    """
    based = _based(docs)
    texts = written(distinct_texts(based), "texts", compression="zstd")
    words, classes = word_reference(based, texts), class_reference(texts)
    known = sorted({lang for lang, _ in classes})
    compared = F.col("lang").isNull() | F.col("lang").isin(known)
    out = with_word_distance(_text(based).withColumn("__words", words_of(F.col("__text"))), [x for x in words if x[0] in known])
    out = out.withColumns({"word_distance": F.when(compared, F.col("word_distance")), "class_distance": F.when(compared, class_distance(classes))})
    far = (((F.col("n_words") >= LEAST_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE))
           | ((F.col("__chars") >= LEAST_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, the two distances and ``kept``, a row for each row of ``docs``."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                               "word_distance", "class_distance", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, as they are."""
    return judged(docs).filter("kept").select("__row.*")


@query("op10_quality")
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents"))
