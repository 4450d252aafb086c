"""Toxicity by weak supervision: voters, a generative label model, a linear classifier (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import coded_words, cut, flags, nothing_kept_in_worker, text_column, text_slices

#: The model is fitted on at most this many labelled documents, the first in the order of a hash of their id.
TRAINING_ROWS = 20_000
#: A voter's own words are chosen without the documents of the fold it votes on.
FOLDS = 3
#: A term is a word, or the beginning of words of at least so many letters, which stands for their inflected forms.
BEGINNINGS = range(3, 9)
#: Lexicon voters at most (the model's size), the weighted labelled documents of label 1 that a term needs, and its
#: log-likelihood gain: over all labelled documents, and where one fold is left out.
LEXICON, LEAST_DOCUMENTS, LEAST_GAIN, LEAST_FOLD_GAIN = 200, 2.0, 24.0, 12.0
#: A term is dense in a text that has it once in this many words; it may be there by chance in one that is longer.
DENSE_WORDS, SHORT_TEXT = 150, 60
#: Dependencies of two voters count from this log-likelihood gain on.
LEAST_DEPENDENCE = 30.0
#: Pattern voters for label 1, as regular expressions over the lower-cased text (fixed, general).
PATTERNS = (r"\byou(?:'re| are)?\s+(?:an?\s+)?(?:stupid|idiot|moron|trash|worthless|pathetic|disgusting)", r"[a-z][*@#$]{2,}[a-z]", r"!{3,}", r"\b(?:shut up|go away|get lost)\b")
STRIP = ".,;:!?\"'()[]{}*&%$#|<>-_"
#: Voters over all terms: several hits, two terms, hits too sparse.
SUMMARIES = 3


def _terms(word: str) -> list[str]:
    """A word freed of punctuation around it, and its beginnings, marked by a plus sign."""
    bare = word.strip(STRIP)
    return [bare, *(bare[:k] + "+" for k in BEGINNINGS if len(bare) > k)] if bare else []


def _covers(a: str, b: str) -> bool:
    """Whether the words of two terms may be the same."""
    x, y = a.rstrip("+"), b.rstrip("+")
    return (x.startswith(y) and b.endswith("+")) or (y.startswith(x) and a.endswith("+")) or x == y


def _counts(texts: pa.Array, numbers_of) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(row, term number, hits) of the terms in each text, each text's words, and the terms by number.

    numbers_of gives the terms of a word.
    """
    words, codes, offsets = coded_words(pc.utf8_lower(texts))
    number: dict[str, int] = {}
    held = [[number.setdefault(t, len(number)) for t in numbers_of(w)] for w in words]
    size = np.fromiter(map(len, held), np.int64, len(held))
    flat = np.fromiter((n for h in held for n in h), np.int64, int(size.sum()))
    full = np.fromiter(map(bool, words), bool, len(words))
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    n_words = np.bincount(row[full[codes]], minlength=len(texts))
    some = size[codes] > 0
    row, codes = row[some], codes[some]
    pair, hits = np.unique(row * max(1, len(words)) + codes, return_counts=True)
    row, code = pair // max(1, len(words)), pair % max(1, len(words))
    times, first = size[code], (np.cumsum(size) - size)[code]
    ends = np.cumsum(times)
    term = flat[np.repeat(first - (ends - times), times) + np.arange(ends[-1] if len(ends) else 0)]
    key, at = np.unique(np.repeat(row, times) * max(1, len(number)) + term, return_inverse=True)
    total = np.bincount(at, np.repeat(hits, times), len(key)).astype(np.int64)
    return key // max(1, len(number)), key % max(1, len(number)), total, n_words, list(number)


def _dense(hits: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return (hits * DENSE_WORDS >= n_words) & ((hits >= 2) | (n_words <= SHORT_TEXT))


def _capped(hits: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Hits that count: one in forty words, so that one text of repeated words does not make a term."""
    return np.minimum(hits, 1 + n_words // 40)


class LabelModel:
    """A generative model of voters that say 1, 0 or nothing (1, -1, 0), fitted on the votes alone.

    Each voter's answers have a distribution under either label; voters that depend on each other given the
    label are joined by a forest of the strongest such dependencies, in which a voter's answers follow from the
    label and one other voter's answer. Expectation maximisation from the voters' majority estimates the share
    of label 1, all distributions and the forest together.
    """

    def fit(self, votes: np.ndarray, rounds: int = 30) -> LabelModel:
        rows, weight = np.unique(votes, axis=0, return_counts=True)
        n, v = rows.shape
        x = (rows[:, :, None] == np.array([-1, 0, 1])).reshape(n, 3 * v).astype(float)
        balance = (rows > 0).sum(axis=1) - (rows < 0).sum(axis=1)
        post = 1 / (1 + np.exp(-2.0 * np.clip(balance, -10, 10)))
        for _ in range(rounds):
            self._estimate(x, weight[:, None] * np.stack([1 - post, post], axis=1), v)
            new = self._posterior(rows)
            if np.abs(new - post).max() < 1e-5:
                break
            post = new
        return self

    def _estimate(self, x: np.ndarray, w: np.ndarray, v: int) -> None:
        total = w.sum(axis=0)
        self.prior = float((total[1] + 1) / (total.sum() + 2))
        joint = np.stack([(x * w[:, y : y + 1]).T @ x for y in (0, 1)]).reshape(2, v, 3, v, 3)
        alone = np.einsum("yiaia->yia", joint)
        self.rates = (alone + 0.1) / (alone.sum(axis=2, keepdims=True) + 0.3)
        # Twice the log-likelihood that knowing one voter adds to another one, given the label.
        expected = alone[:, :, :, None, None] * alone[:, None, None, :, :] / np.maximum(total, 1e-9)[:, None, None, None, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = 2 * np.where(joint > 1e-9, joint * np.log(joint / expected), 0.0).sum(axis=(0, 2, 4))
        np.fill_diagonal(gain, 0.0)
        self.dependence, self.parent = gain, np.full(v, -1)
        best, source, todo = np.zeros(v), np.full(v, -1), set(range(v))
        while todo:
            i = max(todo, key=lambda k: (best[k], -k))
            todo.discard(i)
            self.parent[i] = source[i] if best[i] >= LEAST_DEPENDENCE else -1
            closer = gain[i] > best
            best, source = np.where(closer, gain[i], best), np.where(closer, i, source)
        self.given = np.zeros((2, v, 3, 3))
        for i, p in enumerate(self.parent):
            if p < 0:
                self.given[:, i] = self.rates[:, i, None, :]
            else:  # towards the voter's own distribution where the other's answer is rare
                table = joint[:, p, :, i, :] + 2 * self.rates[:, i, None, :]
                self.given[:, i] = table / table.sum(axis=2, keepdims=True)

    def _posterior(self, rows: np.ndarray) -> np.ndarray:
        own, other = rows + 1, np.where(self.parent >= 0, rows[:, self.parent] + 1, 0)
        i = np.arange(rows.shape[1])
        score = [np.log(self.given[y, i, other, own]).sum(axis=1) for y in (0, 1)]
        odds = np.log(self.prior / (1 - self.prior)) + score[1] - score[0]
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row of votes."""
        rows, at = np.unique(votes, axis=0, return_inverse=True)
        return self._posterior(rows)[at.ravel()]

    def accuracies(self) -> np.ndarray:
        """How often each voter is right when it says anything."""
        share = np.array([1 - self.prior, self.prior])[:, None, None] * self.rates
        return (share[0, :, 0] + share[1, :, 2]) / share[:, :, [0, 2]].sum(axis=(0, 2))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2e-4, rounds: int = 500, rate: float = 0.05) -> np.ndarray:
    """Weights (the last is the constant) by Adam over all rows, on soft labels."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = x.T @ (p - y).astype(np.float32) / len(y) + np.float32(ridge) * np.r_[w[:-1], np.float32(0)]
        mean = 0.9 * mean + 0.1 * step
        square = 0.99 * square + 0.01 * step * step
        w -= rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return w.astype(float)


def _judged(count: np.ndarray, documents: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gain of each term, 0 where it has too few documents or not mostly label 1, and whether only dense hits count.

    count is (terms, kind, label): weighted documents that have the term, that have it densely, and hits.
    """
    here, dense, hits = count[:, 0], count[:, 1], count[:, 2]
    share = lambda c: c[:, 1] / np.maximum(c.sum(axis=1), 1e-9)
    only_dense = share(dense) > share(here) + 0.1
    chosen = np.where(only_dense[:, None], dense, here)
    expected = hits.sum(axis=1, keepdims=True) * words / max(words.sum(), 1e-9)
    gain = 2 * np.where(hits > 0, hits * np.log(np.maximum(hits, 1e-9) / np.maximum(expected, 1e-9)), 0).sum(axis=1)
    more = hits[:, 1] > expected[:, 1]
    return np.where(more & (chosen[:, 1] >= LEAST_DOCUMENTS - 1e-6) & (share(chosen) >= 0.5), gain, 0.0), only_dense


def _lexicon(terms: list[str], count: np.ndarray, documents: np.ndarray, words: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Chosen terms, whether each needs to be dense, and (terms, folds) whether it holds without that fold.

    Counts are (terms, kind, label, fold). Of terms that share words the one with the greatest gain stays, and
    of equal ones the longest.
    """
    gain, dense = _judged(count.sum(axis=3), documents.sum(axis=1), words.sum(axis=1))
    chosen: list[int] = []
    for k in sorted(np.flatnonzero(gain >= LEAST_GAIN).tolist(), key=lambda k: (-gain[k], -len(terms[k].rstrip("+")), terms[k])):
        if len(chosen) < LEXICON and not any(_covers(terms[k], terms[j]) for j in chosen):
            chosen.append(k)
    holds = np.zeros((len(chosen), FOLDS), dtype=bool)
    for f in range(FOLDS):
        rest = [j for j in range(FOLDS) if j != f]
        holds[:, f] = _judged(count[chosen][..., rest].sum(axis=3), documents[:, rest].sum(axis=1), words[:, rest].sum(axis=1))[0] >= LEAST_FOLD_GAIN
    return chosen, dense[chosen], holds


class _Voters:
    """Votes and features of texts."""

    def __init__(self, terms: list[str], dense: np.ndarray):
        self.terms, self.dense, self.number = terms, np.asarray(dense, dtype=bool), {t: k for k, t in enumerate(terms)}

    def _of(self, word: str) -> list[str]:
        return [t for t in _terms(word) if t in self.number][:1]

    def look(self, texts: pa.Array, valid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(votes, features) of each text; valid (rows, terms) says which terms may speak on it."""
        n, v = len(texts), len(self.terms)
        row, term, hits, n_words, found = _counts(texts, self._of)
        term = np.array([self.number[t] for t in found], dtype=np.int64)[term] if len(term) else term
        table = np.zeros((n, v), dtype=np.int64)
        table[row, term] = hits
        if valid is not None:
            table *= valid
        says = (table > 0) & (~self.dense | _dense(table, n_words[:, None]))
        total, several = table.sum(axis=1), says.sum(axis=1)
        low = pc.utf8_lower(texts)
        patterns = np.stack([flags(pc.match_substring_regex(low, p)) for p in PATTERNS], axis=1) if n else np.zeros((0, len(PATTERNS)), bool)
        thick = (total >= 2) & (120 * total >= n_words)
        sparse = 400 * total < n_words
        summary = np.stack([thick.astype(int) - (total == 0), (several >= 2).astype(int) - (several == 0), -sparse.astype(int)], axis=1)
        votes = np.hstack([says.astype(int), patterns.astype(int), summary]).astype(np.int8)
        share = np.minimum(60 * total / np.maximum(n_words, 1), 2.0)
        features = np.hstack([says, patterns, thick[:, None], (several >= 2)[:, None], sparse[:, None], share[:, None], np.minimum(np.log1p(total), 3)[:, None]]).astype(np.float32)
        return votes, features


def fit(df: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Learn from the labelled documents where ``training`` (of the labels' id) holds, at most TRAINING_ROWS of them.

    The labels choose the lexicon: terms whose hits speak for label 1, counted by Spark over the sample, copies
    of a text (the same least word hash) weighing as one. A term votes on a document only if it is also found
    without that document's fold. The label model sees the votes alone, and the linear classifier learns its
    posteriors. Labels other than 0 and 1 and null ones are left out; an id with several labels has the larger,
    one with several texts the one that sorts first; null ids have no label. Texts count whole, however long;
    other columns are not read. With no labelled row, or rows of one kind only, or no term that speaks for
    label 1, every text gets the share of label 1 as its score.
    """
    rows = labels.where(training & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    sample = rows.orderBy(F.xxhash64(id_col), id_col).limit(TRAINING_ROWS)
    joined = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), id_col)
    texts = joined.groupBy(id_col).agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y", F.pmod(F.xxhash64(id_col), F.lit(FOLDS)).cast("int").alias("fold"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            t = text_column(part)
            words, codes, offsets = coded_words(pc.utf8_lower(t))
            hashes = np.array([xxhash.xxh64_intdigest(w) >> 1 if len(w) > 7 else 1 << 62 for w in words] or [0], dtype=np.int64)
            some = np.array([hashes[codes[a:b]].min() if b > a else -1 for a, b in zip(offsets, offsets[1:])], dtype=np.int64)
            short = [xxhash.xxh64_intdigest(x.as_py()) >> 1 if s in (-1, 1 << 62) else int(s) for x, s in zip(t, some)]
            yield pa.RecordBatch.from_arrays([t.cast(pa.string()), part.column("y"), part.column("fold"), pa.array(short, pa.int64())], ["text", "y", "fold", "copy"])

    kept = cut(texts.mapInArrow(keyed, "text string, y int, fold int, copy bigint"))
    sizes = kept.groupBy("copy").agg(F.count(F.lit(1)).alias("copies"))
    kept = kept.join(F.broadcast(sizes), "copy").withColumn("weight", 1 / F.col("copies"))

    def counted(batches: Iterator[pa.RecordBatch], candidates: dict | None) -> Iterator[pa.RecordBatch]:
        of = _terms if candidates is None else (lambda w: [t for t in _terms(w) if t in candidates])
        for part in text_slices(batches):
            row, term, hits, n_words, found = _counts(text_column(part), of)
            weight, fold = part.column("weight").to_numpy(), part.column("fold").to_numpy()
            key, at = np.unique(term * FOLDS + fold[row], return_inverse=True)
            w, n = weight[row], n_words[row]
            sums = [np.bincount(at, x, len(key)) for x in (w, w * _dense(hits, n), w * _capped(hits, n))]
            names = pa.array(found, pa.string()).take(pa.array(key // FOLDS))
            yield pa.RecordBatch.from_arrays([names, pa.array(key % FOLDS, pa.int32()), *map(pa.array, sums)], ["term", "fold", "here", "dense", "hits"])

    schema = "term string, fold int, here double, dense double, hits double"

    def totals(y: int, candidates: dict | None) -> DataFrame:
        found = kept.where(F.col("y") == y).select("text", "fold", "weight").mapInArrow(lambda b: counted(b, candidates), schema)
        return found.groupBy("term").agg(*[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0.0)).alias(f"{c}{f}") for c in ("here", "dense", "hits") for f in range(FOLDS)])

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words, codes, offsets = coded_words(text_column(part))
            full = np.r_[0, np.cumsum(np.fromiter(map(bool, words), bool, len(words))[codes])]
            yield pa.RecordBatch.from_arrays([part.column("y"), part.column("fold"), part.column("weight"), pa.array((full[offsets[1:]] - full[offsets[:-1]]).astype(float))], ["y", "fold", "weight", "words"])

    documents, words = np.zeros((2, FOLDS)), np.zeros((2, FOLDS))
    measured = kept.select("text", "y", "fold", "weight").mapInArrow(lengths, "y int, fold int, weight double, words double")
    for r in measured.groupBy("y", "fold").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("words")).alias("n")).collect():
        documents[r["y"], r["fold"]], words[r["y"], r["fold"]] = r["w"], r["n"]
    share = float((documents[1].sum() + 0.5) / (documents.sum() + 1))
    plain = {"terms": [], "dense": [], "weights": [float(np.log(share / (1 - share)))]}
    if not documents[0].sum() or not documents[1].sum():
        return plain
    enough = sum(F.col(f"here{f}") for f in range(FOLDS)) >= LEAST_DOCUMENTS - 1e-6
    ones = {r["term"]: r for r in totals(1, None).where(enough).toLocalIterator()}
    zeros = {r["term"]: r for r in totals(0, dict.fromkeys(ones)).collect()} if ones else {}
    terms, count = sorted(ones), np.zeros((len(ones), 3, 2, FOLDS))
    for k, t in enumerate(terms):
        for y, found in ((0, zeros.get(t)), (1, ones[t])):
            if found is not None:
                count[k, :, y] = np.array(found[1:]).reshape(3, FOLDS)
    chosen, dense, holds = _lexicon(terms, count, documents, words) if terms else ([], np.zeros(0, bool), None)
    if not chosen:
        return plain
    voters = _Voters([terms[k] for k in chosen], dense)

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            votes, features = voters.look(text_column(part), holds[:, part.column("fold").to_numpy()].T)
            yield pa.RecordBatch.from_arrays([pa.array(list(map(bytes, votes)), pa.binary()), pa.array(list(map(bytes, features)), pa.binary())], ["votes", "features"])

    looked = sorted((bytes(r["votes"]), bytes(r["features"])) for r in kept.select("text", "fold").mapInArrow(table, "votes binary, features binary").collect())
    votes = np.frombuffer(b"".join(a for a, _ in looked), dtype=np.int8).reshape(len(looked), -1)
    features = np.frombuffer(b"".join(b for _, b in looked), dtype=np.float32).reshape(len(looked), -1)
    posterior = LabelModel().fit(votes).posterior(votes)
    return {"terms": voters.terms, "dense": voters.dense.tolist(), "weights": _logistic(features, posterior).tolist()}


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double, predicted int) for every row, from its whole text alone.

    Null and empty texts are scored as texts without words. Repeated rows and null ids are scored each, a very
    long text in a slice of its own; a score of exactly 0.5 is predicted 1; other columns are not read.
    """
    voters, weights = _Voters(model["terms"], np.array(model["dense"], dtype=bool)), np.array(model["weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept_in_worker()
        for part in text_slices(batches):
            odds = np.full(part.num_rows, weights[-1])
            if voters.terms:
                odds += voters.look(text_column(part))[1] @ weights[:-1]
            p = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)
