"""Quality rules from distribution divergence, in DataFrame functions only.

Base rules count words, symbols, repeated lines and words inside repeated 5-word windows. The method compares two histograms
of a document with those of its language: character classes, and the language's most common words against all other words.
The references are fixed shares of general prose in that language, so a verdict never depends on the other rows of a table. A
document is rejected if a Jensen-Shannon distance (base 2, 0 to 1) is above its threshold; documents shorter than the guards,
or in a language without a reference, are judged by the base rules alone.

Everything is computed inside a row from the whole text in one pass: no explode, no join, no shuffle. Repeated windows are
found by sorting window hashes, so a very long document costs n log n.

Defined results: a null text has no words. A null or unknown language has no reference. Rows with equal ids are judged one
by one. An empty table gives an empty result. A table without a language column has no references. Other columns pass through,
whatever their names; columns called like a result (``_tw_n_words`` and so on) make place for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, ROW, WHITE, WORD_GAP, from_row, quoted, with_row

# Common words of each language, written in lower case.
COMMON = {
    "de": ["die", "der", "und", "in", "den", "von", "zu", "mit", "sich", "auf", "für", "ist"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "on", "with", "was"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "las", "por", "un", "con"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "que", "dans", "pour"],
}
#: Counted in what is left of a text without lower-case letters and white space.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "stop": r"[.,;:!?'\"()\-]", "symbol": r"[#*$%&|<>@+=_/\\~^{}\[\]`]"}
# Of a thousand characters in words of general prose, how many are lower-case letters, then of each class, then
# others; and of a thousand words, how many are each common word. Rounded; the rest of the words are others.
CLASS_SHARES = {
    "de": [915, 60, 3, 22, 0, 0],
    "en": [945, 25, 2, 28, 0, 0],
    "es": [945, 25, 3, 27, 0, 0],
    "fr": [945, 22, 3, 28, 0, 2],
}
WORD_SHARES = {
    "de": [33, 33, 29, 17, 13, 10, 11, 9, 8, 8, 7, 9],
    "en": [61, 30, 28, 26, 21, 22, 10, 11, 9, 7, 7, 9],
    "es": [65, 41, 32, 29, 27, 27, 18, 14, 11, 10, 11, 9],
    "fr": [55, 29, 25, 24, 20, 17, 15, 12, 11, 10, 9, 8],
}
MIN_WORDS, MIN_CHARS = 60, 200
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.29
BASE_MIN_WORDS, BASE_MAX_REPEAT = 10, 20


def _call(name: str, *args) -> Column:
    return F.call_function(name, *args)


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def _with_repeated_words(rows: DataFrame) -> DataFrame:
    """_tw_n_repeat_words: words inside 5-word windows found twice or more; only texts with such a window are sorted.

    Each step is a column of its own: inside a lambda an expression would be evaluated again for every element.
    """
    pair = F.transform("_tw_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumn("_tw_pairs", F.when(F.size(F.array_distinct("_tw_hashes")) < F.size("_tw_hashes"), F.array_sort(pair)))
    near = lambda k: F.get("_tw_pairs", k).h
    twice = F.filter("_tw_pairs", lambda x, k: x.h.eqNullSafe(near(k - 1)) | x.h.eqNullSafe(near(k + 1)))
    rows = rows.withColumn("_tw_at", F.array_sort(F.transform(twice, lambda x: x.i)))
    covered = F.transform("_tw_at", lambda p, k: F.when(k == 0, 5).otherwise(F.least(F.lit(5), p - F.get("_tw_at", k - 1))).cast("long"))
    return rows.withColumn("_tw_n_repeat_words", F.coalesce(_total(covered), F.lit(0).cast("long")))


def _by_language(lang: Column, values: dict[str, list]) -> Column:
    """An array of literals for each listed language, else null."""
    return reduce(lambda w, k: w.when(lang == k, F.array(*map(F.lit, values[k]))), values, F)


def with_histograms(rows: DataFrame) -> DataFrame:
    """Rows with _tw_text and _tw_lang plus _tw_words (array), _tw_rest, _tw_word_chars, _tw_classes and _tw_common (arrays of long counts; null without a word list)."""
    longest = max(len(w.encode()) for words in COMMON.values() for w in words)
    raw = F.col("_tw_text")
    out = rows.withColumns({"_tw_trim": F.trim(raw, F.lit(WHITE)), "_tw_rest": F.regexp_replace(raw, r"[\p{Ll}\x20\x09-\x0D]+", ""), "_tw_list": _by_language(F.col("_tw_lang"), COMMON)})
    out = out.withColumn("_tw_words", F.when(F.col("_tw_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_tw_trim", WORD_GAP)))
    out = out.withColumns({"_tw_word_chars": F.length(F.array_join("_tw_words", "")).cast("long"), "_tw_found": F.filter("_tw_words", lambda w: (F.octet_length(w) <= longest) & F.array_contains(F.col("_tw_list"), w))})
    # One letter for each common word that is found, so that each is counted by scanning a short string.
    out = out.withColumn("_tw_letters", F.array_join(F.transform("_tw_found", lambda w: F.substr(F.lit(LOWER), F.array_position("_tw_list", w).cast("int"), F.lit(1))), ""))
    counted = [_call("regexp_count", F.col("_tw_rest"), F.lit(p)).cast("long") for p in CLASSES.values()]
    n_rest = F.length("_tw_rest").cast("long")
    classes = F.array(F.col("_tw_word_chars") - n_rest, *counted, n_rest - reduce(lambda a, b: a + b, counted))
    n_listed = len(next(iter(COMMON.values())))
    n_found = F.length("_tw_letters")
    each = F.array(*[(n_found - F.length(F.replace("_tw_letters", F.lit(LOWER[k]), F.lit("")))).cast("long") for k in range(n_listed)])
    others = (F.size("_tw_words") - n_found).cast("long")
    return out.withColumns({"_tw_classes": classes, "_tw_common": F.when(F.col("_tw_list").isNotNull(), F.concat(each, F.array(others)))}).drop("_tw_trim", "_tw_list", "_tw_found", "_tw_letters")


def distance(counts: Column, total: Column, shares: Column) -> Column:
    """Jensen-Shannon distance, base 2, of an array of counts with this total to an array of shares; null without either.

    ``total`` should be a column: inside the lambda an expression would be evaluated again for every element.
    """

    def term(c, q):
        p = c / total
        half = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / half)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / half)).otherwise(0.0)

    summed = F.aggregate(F.zip_with(counts, shares, term), F.lit(0.0), lambda a, x: a + x)
    return F.when((total > 0) & shares.isNotNull(), F.sqrt(F.greatest(summed / 2, F.lit(0.0))))


RESULTS = ("_tw_n_words", "_tw_word_chars", "_tw_n_symbols", "_tw_n_dup_lines", "_tw_n_repeat_words", "_tw_class_distance", "_tw_word_distance", "_tw_base_failed", "_tw_kept")


def _judged(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """ROW (docs without the text), _tw_text (as it was) and RESULTS."""
    language = F.col(quoted(lang)).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    rows = with_row(docs, (text,), _tw_given=F.col(quoted(text)), _tw_text=F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")), _tw_lang=language)
    shares = lambda of: {k: [x / sum(v) for x in v] for k, v in of.items()}
    words = {k: [*v, 1000 - sum(v)] for k, v in WORD_SHARES.items()}
    rows = with_histograms(rows).withColumns({"_tw_ref_classes": _by_language(F.col("_tw_lang"), shares(CLASS_SHARES)), "_tw_ref_common": _by_language(F.col("_tw_lang"), shares(words)), "_tw_n_words": F.size("_tw_words").cast("long")})
    n = F.size("_tw_words")
    each = F.col("_tw_words")
    hashes = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(each, i + k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("_tw_text", "\n"), lambda x: F.trim(x, F.lit(WHITE)) != "")
    rows = rows.withColumns({"_tw_hashes": hashes, "_tw_lines": lines})
    rows = _with_repeated_words(rows).withColumns(
        {
            "_tw_n_symbols": _call("regexp_count", F.col("_tw_rest"), F.lit(r"[#*$%&|<>]")).cast("long"),
            "_tw_n_dup_lines": (F.size("_tw_lines") - F.size(F.array_distinct("_tw_lines"))).cast("long"),
            "_tw_class_distance": distance(F.col("_tw_classes"), F.col("_tw_word_chars"), F.col("_tw_ref_classes")),
            "_tw_word_distance": distance(F.col("_tw_common"), F.col("_tw_n_words"), F.col("_tw_ref_common")),
        }
    )
    failed = (F.col("_tw_n_words") < BASE_MIN_WORDS) | (100 * F.col("_tw_n_repeat_words") > BASE_MAX_REPEAT * F.col("_tw_n_words"))
    guarded = (F.col("_tw_n_words") >= MIN_WORDS) & (F.col("_tw_word_chars") >= MIN_CHARS)
    diverges = guarded & ((F.coalesce("_tw_class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("_tw_word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE))
    return rows.select(ROW, "_tw_given", *RESULTS[:-2], failed.alias("_tw_base_failed"), (~failed & ~diverges).alias("_tw_kept"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs plus RESULTS: the counts, the distances (null without a reference), and the verdicts."""
    return from_row(_judged(docs, text, lang), docs.columns, **{text: "_tw_given"}, **{c: c for c in RESULTS})


def keep(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without those that are rejected.

    The row number only keeps Catalyst from pushing the filter below the columns it is computed from, which would copy
    their expressions into one predicate many times over; a written table would do so too, but cost a copy of the corpus.
    """
    judged = _judged(docs, text, lang).withColumn("_tw_row_number", F.monotonically_increasing_id())
    return from_row(judged.filter("_tw_kept and _tw_row_number >= 0"), docs.columns, **{text: "_tw_given"})


def op10_quality(spark, sf_dir: str) -> DataFrame:
    from .common import read

    names = {"n_words": "_tw_n_words", "word_chars": "_tw_word_chars", "n_symbols": "_tw_n_symbols", "n_dup_lines": "_tw_n_dup_lines", "n_repeat_words": "_tw_n_repeat_words", "base_failed": "_tw_base_failed", "kept": "_tw_kept"}
    out = judge(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", *[F.col(v).alias(k) for k, v in names.items()])
