"""Quality rules by divergence from language references; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._work import saved

# Common words of each language; other languages take the last row.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
    "": ["the", "of", "and", "der", "die", "und", "de", "la", "le", "que", "el", "en"],
}
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
#: Classes of characters, taken off one after another; what is left is a class too.
CLASSES = {"lower": r"[a-z]+", "blank": BLANKS, "upper": r"[A-Z]+", "symbol": SYMBOLS, "digit": r"[0-9]+", "sign": r"[\x00-\x7F]+"}
LEAST_WORDS = 50
#: Texts of fewer words are not held against the reference of classes, of common words; nor is any where a reference has too few words.
GUARD_CLASS, GUARD_COMMON, GUARD_REFERENCE = 50, 100, 5000
#: Largest Jensen-Shannon distances from the reference.
MOST_CLASS, MOST_COMMON = 0.25, 0.22
_PLACES = (1 << 24) - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _common() -> Column:
    return F.create_map(*(x for k, words in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, words)))))


def _repeated(words: Column) -> Column:
    """How many words stand in 3-word windows that are found twice or more in the text.

    Windows are sorted by a hash with their place in its low bits; only those that meet a neighbour in
    the high bits are sorted again by the whole hash.
    """

    def twins(s: Column, same: Callable[[Column], Column]) -> Column:
        return F.filter(s, lambda x, k: (same(F.get(s, k - 1)) == same(x)) | (same(F.get(s, k + 1)) == same(x)))

    def count(h: Column) -> Column:
        high = lambda x: x.bitwiseAND(F.lit(~_PLACES))
        packed = F.sort_array(F.transform(h, lambda x, i: high(x).bitwiseOR(i.cast("long"))))
        likely = F.when(F.size(h) <= _PLACES, let(packed, lambda s: F.transform(twins(s, high), lambda x: x.bitwiseAND(F.lit(_PLACES)).cast("int")))).otherwise(F.sequence(F.lit(0), F.size(h) - 1))
        whole = F.sort_array(F.transform(likely, lambda p: F.struct(F.get(h, p).alias("h"), p.alias("p"))))
        sure = let(whole, lambda s: F.transform(twins(s, lambda x: x["h"]), lambda x: x["p"]))
        return F.size(F.array_distinct(F.flatten(F.transform(sure, lambda p: F.array(p, p + 1, p + 2)))))

    hashes = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    return F.when(F.size(words) >= 3, let(hashes, count)).otherwise(0).cast("long")


def features(docs: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """The rows of `docs` (text, lang, others) as q_row, and the counts of each text (null: empty).

    q_row: all columns but a name of `without`, as one struct, so that no name can clash; q_words, q_word_chars, q_symbols, q_dup_lines, q_repeat_words; q_group: the language, '' if it has no
    row in COMMON; q_class: characters of each class; q_common: each common word, and all others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    names = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in without]
    out = docs.select(F.struct(*names).alias("q_row"), "text", "lang").withColumn("q_group", F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise(""))
    out = out.withColumn("q_list", F.filter(F.split(text, BLANKS), lambda x: x != ""))
    left, sizes = text, []
    for k, pattern in enumerate(CLASSES.values()):
        out = out.withColumn(f"q_left{k}", F.regexp_replace(left, pattern, ""))
        sizes.append(F.length(left) - F.length(f"q_left{k}"))
        left = F.col(f"q_left{k}")
    sizes.append(F.length(left))
    common = let(F.try_element_at(_common(), F.col("q_group")), lambda c: let(F.filter("q_list", lambda x: F.array_contains(c, x)), lambda found: F.concat(F.transform(c, lambda w: F.size(F.filter(found, lambda x: x == w))), F.array(F.size("q_list") - F.size(found)))))
    return (
        out.withColumn("q_class", F.array(*(s.cast("long") for s in sizes)))
        .withColumn("q_words", F.size("q_list").cast("long"))
        .withColumn("q_word_chars", (F.length(text) - F.col("q_class")[1]).cast("long"))
        .withColumn("q_symbols", F.col("q_class")[list(CLASSES).index("symbol")])
        .withColumn("q_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("q_repeat_words", _repeated(F.col("q_list")))
        .withColumn("q_common", common)
        .drop("text", "lang", "q_list", *(f"q_left{k}" for k in range(len(CLASSES))))
    )


def references(found: DataFrame) -> DataFrame:
    """q_group, r_words, r_class, r_common: the sums over each group's texts of LEAST_WORDS words or more.

    At most as many rows as COMMON has, so the join with it may be broadcast.
    """
    sums = lambda name, n: F.array(*(F.sum(F.col(name)[i]) for i in range(n)))
    wide = len(COMMON["en"]) + 1
    return found.where(F.col("q_words") >= LEAST_WORDS).groupBy("q_group").agg(F.sum("q_words").alias("r_words"), sums("q_class", len(CLASSES) + 1).alias("r_class"), sums("q_common", wide).alias("r_common"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of counts; null if either has none."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    share = lambda x: let(total(x), lambda t: F.transform(x, lambda v: F.when(t > 0, v / t)))
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(share(p), share(q), lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), total(terms)))


def judge(docs: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """q_row, the q_ counts, q_base_failed and q_kept of each row of `docs` (see `features`).

    A text fails the base rules with fewer than LEAST_WORDS words or more than half of its words in
    repeated windows. Of the others, a text is dropped when its character classes or its common words
    are too far from its language's reference, unless it or the reference is too short to tell. Null
    texts are empty, null languages the group ''. Every row gives one row. The counts are made once
    and saved; references and verdicts read them.
    """
    found = saved(features(docs, without))
    joined = found.join(F.broadcast(references(found)), "q_group", "left")
    failed = (F.col("q_words") < LEAST_WORDS) | (100 * F.col("q_repeat_words") > 50 * F.col("q_words"))
    far = (F.col("q_words") >= GUARD_CLASS) & (F.col("q_class_distance") > MOST_CLASS) | (F.col("q_words") >= GUARD_COMMON) & (F.col("q_common_distance") > MOST_COMMON)
    return (
        joined.withColumn("q_class_distance", distance(F.col("q_class"), F.col("r_class")))
        .withColumn("q_common_distance", distance(F.col("q_common"), F.col("r_common")))
        .withColumn("q_base_failed", failed)
        .withColumn("q_kept", ~F.col("q_base_failed") & ~F.coalesce((F.col("r_words") >= GUARD_REFERENCE) & far, F.lit(False)))
    )


def passed(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with the columns of docs, whatever their names."""
    return judge(docs).where("q_kept").select("q_row.*")


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    names = {"q_words": "n_words", "q_word_chars": "word_chars", "q_symbols": "n_symbols", "q_dup_lines": "n_dup_lines", "q_repeat_words": "n_repeat_words", "q_base_failed": "base_failed", "q_kept": "kept"}
    found = judge(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), without=("text", "lang"))
    return found.select("q_row.doc_id", *(F.col(k).alias(v) for k, v in names.items()))
