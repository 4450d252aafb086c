"""Document quality as a Bradley-Terry ranking learned from preference pairs (operator 11)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import coded_words, cut, nothing_kept_in_worker, text_column, text_slices

#: The model is fitted on at most this many labelled documents, the first in the order of a hash of their id.
TRAINING_ROWS = 20_000
#: Opponents of each document of the rarer label; each pair is one preference.
OPPONENTS = 24
RIDGE = 1e-3
#: A document at the threshold has this score.
PREDICTED_FROM = 0.7
#: Kinds of characters in a word, as RE2 patterns.
KINDS = {"letters": r"\p{L}", "upper": r"\p{Lu}", "digits": r"\p{Nd}", "symbols": r"[#*$%&|<>@^~_=\\{}\[\]/+]", "calls": r"[!?]", "stops": r"[.,;:]"}
FEATURES = ("few_words", "word_length", "letters", "upper", "digits", "symbols", "calls", "stops", "symbol_words", "loud_words", "call_words", "lone_marks", "distinct", "top_word", "stutter", "repeated", "copied_lines", "line_words", "sentence_words", "long_words")


def features(texts: pa.Array) -> np.ndarray:
    """(rows, FEATURES) of whole texts: shares of characters and words of several kinds, and of repetition.

    All are bounded, so a very long text is described as a short one is; a text without words is all zeros but for
    the first feature.
    """
    words, codes, offsets = coded_words(texts)
    uniq = pa.array(words, pa.large_string())
    full = np.fromiter(map(bool, words), bool, len(words))
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    some = full[codes] if len(codes) else np.zeros(0, bool)
    row, codes = row[some], codes[some].astype(np.int64)
    n = np.bincount(row, minlength=len(texts)).astype(float)
    per_word = np.maximum(n, 1)

    def of(values: np.ndarray) -> np.ndarray:
        return np.bincount(row, values[codes].astype(float), len(texts))

    size = pc.utf8_length(uniq).to_numpy().astype(float)
    has = {k: pc.count_substring_regex(uniq, p).to_numpy().astype(float) for k, p in KINDS.items()}
    chars = np.maximum(of(size), 1)
    share = {k: of(v) / chars for k, v in has.items()}
    pair, times = np.unique(row * max(1, len(words)) + codes, return_counts=True)
    owner = pair // max(1, len(words))
    distinct = np.bincount(owner, minlength=len(texts))
    top = np.zeros(len(texts))
    np.maximum.at(top, owner, times)
    again = np.bincount(owner, times * (times > 1 + n[owner] / 25), len(texts))
    same = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    stutter = np.bincount(row[1:][same], minlength=len(texts))
    lines = pc.split_pattern(texts, "\n")
    at = np.asarray(lines.offsets, dtype=np.int64)
    line_row = np.repeat(np.arange(len(texts)), np.diff(at))
    filled = pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(lines.flatten())), 0).to_numpy(zero_copy_only=False).astype(bool)
    coded = lines.flatten().dictionary_encode()
    line_code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_lines = np.bincount(line_row[filled], minlength=len(texts))
    kinds = np.unique(line_row[filled] * max(1, len(coded.dictionary)) + line_code[filled]) // max(1, len(coded.dictionary))
    copied = n_lines - np.bincount(kinds, minlength=len(texts))
    loud = (has["upper"] >= 2) & (has["upper"] == has["letters"])
    long_enough = n >= 20
    out = [
        1 / (1 + n / 10), np.minimum(chars / per_word, 40) / 10 * (n > 0), share["letters"], share["upper"], share["digits"], share["symbols"], share["calls"], share["stops"],
        of(has["symbols"] > 0) / per_word, of(loud) / per_word, of(has["calls"] > 0) / per_word, of((has["letters"] + has["digits"]) == 0) / per_word,
        np.where(long_enough, distinct / per_word ** 0.85, 0.6), np.where(long_enough, top / per_word, 0), stutter / per_word, np.where(long_enough, again / per_word, 0), copied / np.maximum(n_lines, 1),
        np.log1p(np.minimum(n / np.maximum(n_lines, 1), 1000)) / 5, np.log1p(np.minimum(per_word / np.maximum(of(has["stops"] > 0), 1), 1000)) / 5, of(size > 24) / per_word,
    ]
    return np.stack([np.asarray(x, dtype=float) for x in out], axis=1)


def bradley_terry(better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, rounds: int = 40) -> np.ndarray:
    """Weights w under which w . (better - worse) explains the preferences best: logistic loss, by Newton steps."""
    x = better - worse
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w)), x.T @ p / len(x) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def preferences(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (better, worse) of row numbers: each row of the rarer label with OPPONENTS rows of the other one."""
    ones, zeros = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rare, other = (zeros, ones) if len(zeros) <= len(ones) else (ones, zeros)
    left = np.repeat(rare, min(OPPONENTS, len(other)))
    right = other[np.arange(len(left)) % len(other)] if len(other) else left
    return (right, left) if rare is zeros else (left, right)


def describe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<float>) of every row, from its whole text alone.

    Texts are read once and only here; learning, the threshold and scores go on from these few numbers a row. Null and
    empty texts are texts without words; repeated rows and null ids are described each; a very long text is a slice
    of its own. Other columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept_in_worker()
        for part in text_slices(batches):
            x = features(text_column(part)).astype(np.float32)
            held = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("id"), held], ["id", "x"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return cut(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<float>").withColumnRenamed("id", id_col))


def _odds(weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(F.col("x").cast("array<double>"), F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def fit(described: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", label_col: str = "quality") -> dict:
    """Learn a ranking from the labelled documents where ``training`` (of the labels' id) holds.

    Pairs are drawn from at most TRAINING_ROWS of them. The threshold is the quantile of the scores of all of them at
    the share of label 0, so the ranking decides which documents fall below it and the labels how many. Labels other
    than 0 and 1 and null ones are left out; an id with several labels has the larger one, one with several texts
    counts each, null ids have no label. With no labelled row, or rows of one kind only, every text gets the share of
    label 1 as its score.
    """
    rows = labels.where(training & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    known = cut(described.join(rows, id_col).select(F.col(id_col).alias("id"), "y", "x"))
    total = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(1 - F.col("y")), F.lit(0)).alias("zeros")).first()
    share = (total["n"] - total["zeros"] + 0.5) / (total["n"] + 1)
    if not 0 < total["zeros"] < total["n"]:
        return {"weights": None, "share": share}
    sample = known.orderBy(F.xxhash64("id"), "id", "x").limit(TRAINING_ROWS).collect()
    y, x = np.array([r["y"] for r in sample]), np.array([r["x"] for r in sample])
    if y.min() == y.max():
        return {"weights": None, "share": share}
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    better, worse = preferences(y)
    z = (x - mean) / spread
    weights = (bradley_terry(z[better], z[worse]) / spread).tolist()
    level = (total["zeros"] - 0.5) / max(1, total["n"] - 1)
    threshold = known.select(_odds(weights).alias("s")).agg(F.percentile("s", level)).first()[0]
    return {"weights": weights, "share": share, "threshold": float(threshold)}


def score(described: DataFrame, model: dict, id_col: str = "doc_id") -> DataFrame:
    """(id, score double, predicted int) of every described row; predicted is 1 from a score of 0.7 on.

    The score is a logistic function of the ranking's distance from the threshold, at which it is 0.7.
    """
    if model["weights"] is None:
        found = F.lit(float(model["share"]))
    else:
        from_threshold = _odds(model["weights"]) - model["threshold"] + math.log(PREDICTED_FROM / (1 - PREDICTED_FROM))
        found = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), from_threshold))))
    return described.select(id_col, found.alias("score")).withColumn("predicted", (F.col("score") >= PREDICTED_FROM).cast("int"))
