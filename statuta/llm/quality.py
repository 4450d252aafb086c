"""Quality rules and distribution divergence, in DataFrame functions only (operator 6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.llm.common import cut

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
#: The common words of a language are the words that most of its documents have, so many of them.
COMMON_WORDS = 8
#: Lists of common words are broadcast up to so many languages, and joined with a shuffle beyond.
MOST_BROADCAST = 10_000
#: Character classes: how many characters of each a text has; letters that are not upper-case and others are the rest.
CLASSES = {"upper": r"[^\p{Lu}]+", "digit": r"[^0-9]+", "stop": r"[^.,;:!?'\"()\-]+"}
#: Shorter texts have histograms too uncertain to be judged.
LEAST_WORDS, LEAST_COMMON = 50, 20
#: Largest Jensen-Shannon distances (0 to 1) from the language's reference.
MOST_CLASS, MOST_WORD = 0.33, 0.55


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, also where body refers to it inside its own lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words of an array that lie in a window of ``window`` words found twice or more in it."""

    def covered(hashes: Column) -> Column:
        def marked(order: Column) -> Column:
            twin = lambda x, i: (F.get(order, i - 1)["h"] == x["h"]) | (F.get(order, i + 1)["h"] == x["h"])
            places = F.sort_array(F.transform(F.filter(order, lambda x, i: F.coalesce(twin(x, i), F.lit(False)) | ((i > 0) & (F.get(order, i - 1)["h"] == x["h"]))), lambda x: x["p"]))
            start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("bigint").alias("n"))
            step = lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(window), p - s["last"])).alias("n"))
            return F.aggregate(places, start, step, lambda s: s["n"])

        paired = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(let(paired, marked))

    def windows(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(own) - (window - 1)), lambda i: F.xxhash64(F.slice(own, i, window)))

    return F.when(F.size(words) < window + 1, F.lit(0).cast("bigint")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda own: let(windows(own), covered)))


def _share(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: F.when(total > 0, c / total).otherwise(F.lit(0.0)))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares: the square root of the divergence in bits, 0 to 1."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t), F.lit(0.0)))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def common_words(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(reference, common): the COMMON_WORDS words that most documents of each language have, in that order, ties by word.

    Counted over all rows; null is a language of its own, written as the empty name.
    """
    own = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("reference"), F.explode(F.array_distinct(words_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))).alias("word"))
    counted = own.groupBy("reference", "word").agg(F.count(F.lit(1)).alias("n"))
    placed = counted.withColumn("at", F.row_number().over(W.partitionBy("reference").orderBy(F.desc("n"), "word"))).where(F.col("at") <= COMMON_WORDS)
    return placed.groupBy("reference").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("common"))


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts of every row from its whole text: the base counts, and those behind both histograms."""
    lists = cut(common_words(df, text_col, lang_col))
    lists = F.broadcast(lists) if lists.count() <= MOST_BROADCAST else lists
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("q_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("reference"), text.alias("q_text"))
    rows = rows.join(lists, "reference", "left").withColumn("common", F.coalesce("common", F.array().cast("array<string>"))).withColumn("q_words", words_of(F.col("q_text")))
    lines = F.filter(F.split("q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    spread = let(F.col("common"), lambda list_: let(F.filter(F.col("q_words"), lambda w: F.array_contains(list_, w)), lambda own: F.transform(list_, lambda k: F.size(F.filter(own, lambda w: w == k)).cast("bigint"))))
    left = lambda pattern: F.length(F.regexp_replace("q_text", pattern, "")).cast("bigint")
    return rows.select(
        F.col("q_id").alias(id_col),
        "reference",
        F.size("q_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("q_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("q_text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("q_words")).alias("n_repeat_words"),
        F.array(*[left(p) for p in CLASSES.values()]).alias("class_counts"),
        spread.alias("common_counts"),
    ).withColumn("class_counts", F.concat("class_counts", F.array("n_symbols", F.greatest(F.lit(0).cast("bigint"), F.col("word_chars") - F.col("n_symbols") - F.aggregate("class_counts", F.lit(0).cast("bigint"), lambda s, x: s + x)))))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_class: float = MOST_CLASS, most_word: float = MOST_WORD) -> DataFrame:
    """Base counts, both distances and the verdict of every row.

    The references are the summed histograms of all rows of a language, over character classes and over the
    language's own common words. A row is rejected where the base
    rules fail, or where it has LEAST_WORDS words and its character classes, or its at least LEAST_COMMON
    common words, are farther from its language's reference than allowed. Null and empty texts have no words
    and fail the base rules; rows of an unknown language are compared with all such rows; repeated rows are
    judged alike, null ids too; other columns are not read. Very long texts count whole.
    """
    found = cut(features(df, id_col, text_col, lang_col))
    add = lambda name, n: F.array(*[F.sum(F.get(name, k)) for k in range(n)])
    n_class = len(CLASSES) + 2
    references = found.groupBy("reference").agg(add("class_counts", n_class).alias("all_classes"), F.array_compact(add("common_counts", COMMON_WORDS)).alias("all_common"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    joined = found.join(references, "reference")
    scored = joined.select(
        "*",
        jensen_shannon(_share(F.col("class_counts"), total("class_counts")), _share(F.col("all_classes"), total("all_classes"))).alias("class_distance"),
        F.when(total("common_counts") >= LEAST_COMMON, jensen_shannon(_share(F.col("common_counts"), total("common_counts")), _share(F.col("all_common"), total("all_common")))).alias("word_distance"),
    )
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = (F.col("n_words") >= LEAST_WORDS) & ((F.col("class_distance") > most_class) | F.coalesce(F.col("word_distance") > most_word, F.lit(False)))
    return scored.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~far).drop("all_classes", "all_common", "class_counts", "common_counts")
