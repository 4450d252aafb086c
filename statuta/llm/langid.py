"""Language identification by a bidirectional gated recurrent network over bytes (operator 10)."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.llm.common import flags, kept_in_worker, nothing_kept_in_worker, text_column, text_slices

UNKNOWN = "und"
#: Training uses at most this many documents of each language, and windows of so many bytes of each document; every
#: language is learned.
DOCUMENTS_PER_LANGUAGE = 160
WINDOWS_PER_DOCUMENT, WINDOW_BYTES, SHORT_WORD = 24, 48, 4
#: A text is read in chunks of this many bytes, each with some of its neighbours' on both sides, which are read and
#: not labelled; so every byte of a text is labelled once, with that much context at least.
CHUNK_BYTES, CONTEXT_BYTES = 640, 32
#: Chunks that go through the network together, and bytes of text.
CHUNKS, SLICE_TEXT = 1024, 2 << 20
STATE, EMBEDDING = 16, 12
#: A language's documents are ranked in so many parts first.
SALTS = 64
#: Tables with a column a language get fewer rows where there are more languages than this.
USUAL_LANGUAGES = 64


class ByteGru:
    """Two gated recurrent layers that read byte strings from both ends.

    Strings stand in columns, a byte a row; the byte 0 is padding and empties the state. Every position gets a
    softmax over the languages from both states there. Weights are stacked as update gate, reset gate, candidate.
    """

    def __init__(self, classes: int, rng: np.random.Generator | None = None):
        rng = rng or np.random.default_rng(7)
        near = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        self.p = {"embed": rng.standard_normal((256, EMBEDDING)).astype(np.float32) / 4, "out": near(2 * STATE, classes), "bias": np.zeros(classes, np.float32)}
        for d in "fb":
            self.p |= {f"{d}w": near(3, EMBEDDING, STATE), f"{d}u": near(2, STATE, STATE), f"{d}c": near(STATE, STATE), f"{d}b": np.zeros((3, STATE), np.float32)}

    def _read(self, x: np.ndarray, d: str, scores: np.ndarray, keep: list | None = None) -> None:
        """Add to scores (length, classes, batch) those of the states over x (length, batch); d is f (from the start) or b (from the end).

        A state is a row of STATE numbers, so a byte's inputs are copied as whole rows; no state outlives its step
        unless it is kept for training.
        """
        p, (length, n) = self.p, x.shape
        # tanh gives the sigmoid of twice its argument, so the gates' inputs are halved.
        table = (p["embed"] @ p[f"{d}w"] + p[f"{d}b"][:, None]) * np.array([0.5, 0.5, 1], np.float32)[:, None, None]
        inner, candidate = p[f"{d}u"] * np.float32(0.5), p[f"{d}c"]
        out = np.ascontiguousarray(p["out"].reshape(2, STATE, -1)["fb".index(d)].T)
        h, new, some = (np.zeros((n, STATE), np.float32) for _ in range(3))
        given, more, own = np.empty((3, n, STATE), np.float32), np.empty((2, n, STATE), np.float32), np.empty(scores.shape[1:], np.float32)
        padded = (x == 0).any(axis=1)
        for t in range(length) if d == "f" else reversed(range(length)):
            if keep is not None:
                given, new = np.empty_like(given), np.empty_like(new)
            np.take(table, x[t], axis=1, out=given, mode="clip")
            gates, c = given[:2], given[2]
            gates += np.matmul(h, inner, out=more)
            np.tanh(gates, out=gates)
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            z, r = gates
            c += np.matmul(np.multiply(r, h, out=some), candidate, out=more[0])
            np.tanh(c, out=c)
            np.subtract(c, h, out=new)
            new *= z
            new += h
            if padded[t]:
                new[x[t] == 0] = 0
            scores[t] += np.matmul(out, new.T, out=own)
            if keep is not None:
                keep.append((t, h, z, r, c, new))
            h, new = new, h

    def positions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Language probabilities (length, classes, batch)."""
        scores = np.empty((len(x), len(self.p["bias"]), x.shape[1]), np.float32)
        scores[:] = self.p["bias"][:, None]
        for d in "fb":
            self._read(x, d, scores, None if keep is None else keep.setdefault(d, []))
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        return scores

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions that are no padding, and its gradients by backpropagation through time."""
        p, kept = self.p, {}
        prob = self.positions(x, kept)
        length, n = x.shape
        here = (x != 0).astype(np.float32)
        total = max(1.0, float(here.sum()))
        hit = (np.arange(length)[:, None], y[None, :], np.arange(n)[None, :])
        loss = float((-np.log(prob[hit] + 1e-9) * here).sum() / total)
        delta = prob
        delta[hit] -= 1
        delta *= here[:, None, :] / np.float32(total)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["bias"] = delta.sum(axis=(0, 2))
        by_byte = np.argsort(x, axis=None, kind="stable")
        seen, first = np.unique(x.ravel()[by_byte], return_index=True)
        for k, d in enumerate("fb"):
            half = slice(k * STATE, (k + 1) * STATE)
            u, candidate = p[f"{d}u"], p[f"{d}c"]
            carried, moved = np.zeros((n, STATE), np.float32), np.empty((3, length, n, STATE), np.float32)
            for t, h, z, r, c, new in reversed(kept[d]):
                g["out"][half] += (delta[t] @ new).T
                dh = (delta[t].T @ p["out"][half].T + carried) * here[t][:, None]
                dc = dh * z * (1 - c * c)
                drh = dc @ candidate.T
                gates = np.stack([dh * (c - h) * z * (1 - z), drh * h * r * (1 - r)])
                moved[:2, t], moved[2, t] = gates, dc
                carried = dh * (1 - z) + drh * r + gates[0] @ u[0].T + gates[1] @ u[1].T
                g[f"{d}u"] += h.T @ gates
                g[f"{d}c"] += (r * h).T @ dc
            table = np.zeros((3, 256, STATE), np.float32)
            table[:, seen] = np.add.reduceat(moved.reshape(3, length * n, STATE)[:, by_byte], first, axis=1)
            g[f"{d}w"] = p["embed"].T @ table
            g[f"{d}b"] = table.sum(axis=1)
            g["embed"] += (table @ p[f"{d}w"].transpose(0, 2, 1)).sum(axis=0)
        return loss, g


def train(windows: list[bytes], labels: np.ndarray, classes: int, steps: int = 500, batch: int = 256, rate: float = 0.02, seed: int = 11) -> ByteGru:
    """Fit by Adam on batches of windows of text, drawn with as many of each class; shorter ones are padded."""
    rng = np.random.default_rng(seed)
    net = ByteGru(classes, rng)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    own = [np.flatnonzero(labels == k) for k in range(classes)]
    for step in range(1, steps + 1):
        kinds = rng.permutation(np.arange(batch) % classes) if classes <= batch else rng.integers(0, classes, batch)
        rows = [own[k][rng.integers(len(own[k]))] for k in kinds]
        held = [windows[i] for i in rows]
        length = max(map(len, held))
        x = np.frombuffer(b"".join(w.ljust(length, b"\0") for w in held), dtype=np.uint8).reshape(batch, length).T
        _, g = net.gradients(np.ascontiguousarray(x), labels[rows])
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        now = rate * (1 - 0.95 * step / steps) * min(1.0, 1.0 / (size + 1e-9))
        for name, v in g.items():
            mean[name] = 0.9 * mean[name] + 0.1 * v
            square[name] = 0.99 * square[name] + 0.01 * v * v
            net.p[name] -= np.float32(now) * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-6)
    return net


def _save(net: ByteGru, languages: list[str]) -> bytes:
    out = io.BytesIO()
    np.savez(out, languages=np.array(languages), **net.p)
    return out.getvalue()


class _Scorer:
    """A worker's network."""

    def __init__(self, model: bytes):
        held = dict(np.load(io.BytesIO(model)))
        self.languages = [str(x) for x in held.pop("languages")]
        self.net = ByteGru(len(self.languages))
        self.net.p = held

    def texts(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; sums of position probabilities are taken chunk by chunk."""
        letters = flags(pc.match_substring_regex(texts, r"\p{L}"))
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        sums = np.zeros((len(texts), len(self.languages)))
        size = np.where(letters, np.diff(offsets), 0)
        count = -(-size // CHUNK_BYTES)
        owner = np.repeat(np.arange(len(texts)), count)
        begin = offsets[:-1][owner] + CHUNK_BYTES * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
        low, high = offsets[:-1][owner], offsets[1:][owner]
        length = np.minimum(CHUNK_BYTES, high - begin)
        order = np.argsort(length, kind="stable")
        step = max(1, min(CHUNKS, CHUNKS * USUAL_LANGUAGES // max(1, len(self.languages))))
        for first in range(0, len(order), step):
            some = order[first : first + step]
            longest = int(length[some].max())
            at = np.arange(-CONTEXT_BYTES, longest + CONTEXT_BYTES)[:, None] + begin[some]
            inside = (at >= low[some]) & (at < high[some])
            x = np.where(inside, raw[np.clip(at, 0, len(raw) - 1)], 0).astype(np.uint8)
            found = self.net.positions(x)[CONTEXT_BYTES : CONTEXT_BYTES + longest]
            own = (np.arange(longest)[:, None] < length[some]).astype(np.float32)
            np.add.at(sums, owner[some], np.einsum("tkb,tb->bk", found, own))
        total = sums.sum(axis=1)
        known = letters & (total > 0)
        best = sums.argmax(axis=1) if self.languages else np.zeros(len(texts), dtype=int)
        score = np.where(known, sums.max(axis=1, initial=0) / np.where(total > 0, total, 1), 0.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], np.clip(score, 0.0, 1.0)


def _scorer(model: bytes) -> _Scorer:
    return kept_in_worker(("langid", model), lambda: _Scorer(model))


def _windows(raw: bytes) -> list[bytes]:
    """Stretches of a text at places that a hash of it chooses, all of it where it is short.

    One in four is of the text's short words alone, since many texts are lists or headings of such words.
    """
    short = b" ".join(w for w in raw.split() if len(w) <= SHORT_WORD)
    rng, out = np.random.default_rng(xxhash.xxh64_intdigest(raw)), []
    for text, most in ((raw, WINDOWS_PER_DOCUMENT * 3 // 4), (short, WINDOWS_PER_DOCUMENT // 4)):
        if len(text) <= WINDOW_BYTES:
            out += [text] * bool(text)
        else:
            places = rng.integers(0, len(text) - WINDOW_BYTES + 1, min(most, -(-len(text) // WINDOW_BYTES)))
            out += [text[k : k + WINDOW_BYTES] for k in places.tolist()]
    return out


def fit(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> bytes:
    """Train on a bounded sample of the rows where ``training`` holds and the language is known.

    The sample: of each language the DOCUMENTS_PER_LANGUAGE first documents in the order of a hash of their id,
    and of each of these at most WINDOWS_PER_DOCUMENT windows of WINDOW_BYTES bytes, which one task learns from;
    neither repeated rows nor long texts make its share grow. An id with several texts
    of a language gives the one that sorts first; null ids and null or empty texts are not learned; other
    columns are not read. Returns the model as bytes. With no such rows it knows no language and calls every
    text ``und``.
    """
    usable = training & F.col(lang_col).isNotNull() & (F.col(text_col).cast("string") != "") & F.col(id_col).isNotNull()
    named = df.where(usable).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    # The first of each language among those with one salt, then among all; so no task sorts a whole language.
    ranked = named.select("id", "lang").distinct().withColumn("h", F.xxhash64("id")).withColumn("salt", F.pmod("h", F.lit(SALTS)))
    for key in (["lang", "salt"], ["lang"]):
        ranked = ranked.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("h", "id"))).where(F.col("n") <= DOCUMENTS_PER_LANGUAGE)
    first = ranked.select("id", "lang")
    texts = named.join(F.broadcast(first), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            held = [(lang, w) for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()) for w in _windows(text.encode())]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.string()), pa.array([w for _, w in held], pa.binary())], ["lang", "piece"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept_in_worker()
        found = sorted(pair for b in batches for pair in zip(b.column("lang").to_pylist(), b.column("piece").to_pylist()))
        languages = sorted({x for x, _ in found})
        number = {x: k for k, x in enumerate(languages)}
        net = train([w for _, w in found], np.array([number[x] for x, _ in found]), len(languages)) if languages else ByteGru(0)
        yield pa.RecordBatch.from_arrays([pa.array([_save(net, languages)], pa.binary())], ["model"])

    pieces = texts.mapInArrow(cut_windows, "lang string, piece binary").repartition(1)
    held = pieces.mapInArrow(learn, "model binary").collect()
    return bytes(held[0]["model"]) if held else _save(ByteGru(0), [])


def predict(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, lang_pred, score[, text]) for every row, from its text alone.

    The network labels every byte of every text, white space included; a text's language is the one with the
    largest mean probability over its positions, which is the score, and of equal ones the first by name. Null
    texts and texts without a letter are ``und`` with score 0. Repeated rows and null ids are judged each, a
    very long text in a slice of its own; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for part in text_slices(batches, limit=SLICE_TEXT):
            names, score = scorer.texts(text_column(part)) if scorer.languages else ([UNKNOWN] * part.num_rows, np.zeros(part.num_rows))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), *([part.column("text")] if with_text else [])], ["id", "lang_pred", "score", *(["text"] if with_text else [])])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double" + ", text string" * with_text).withColumnRenamed("id", id_col)
