"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue (operator 5)."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import product
from operator import or_
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import PLAIN_WORD, Parts, flags, gathered, kept_in_worker, letters_and_marks, text_column, text_slices

#: A worker remembers its latest pre-tokens, so many in each of two generations (about 300 bytes each).
CACHE_TOKENS = 300_000
#: Bytes of text whose distinct words are looked up together.
SLICE_TEXT = 8 << 20
#: A byte as the high one of two.
HIGH = [b << 8 for b in range(256)]
#: Longer strings are encoded each time, so that the cache stays small in bytes as well.
CACHE_CHARS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes by rank from a file with a base64 token and a rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Merges one pre-token at a time.

    Each merge rank has a bucket of linked-list positions whose pair has that rank: one position, or a heap of
    several. Two levels of whole numbers say which buckets hold anything (a bit for each bucket of a stretch of
    256 ranks, and one for each stretch), so find-first-set on two numbers gives the lowest rank. Positions whose
    pair has changed meanwhile are stale and skipped when they come up. n bytes take O(n log n) time however
    long the pre-token is.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [ranks.get(bytes([b]), -1) for b in range(256)]
        # What two neighbouring tokens merge into, by both their ranks in one number.
        get = ranks.get
        halves = ((get(t[:k], -1), get(t[k:], -1), r) for t, r in ranks.items() for k in range(1, len(t)))
        self.merged = {a << 24 | b: r for a, b, r in halves if a >= 0 and b >= 0}
        self.byte_pairs = [get(bytes(two), -1) for two in product(range(256), repeat=2)]
        self.leaf = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        self.bucket: dict[int, int | list[int]] = {}

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        leaf, bucket, rank_of = self.leaf, self.bucket, self.merged.get
        token = list(map(self.bytes.__getitem__, piece))
        n, top = len(piece), 0
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pair = list(map(self.byte_pairs.__getitem__, map(or_, map(HIGH.__getitem__, piece), piece[1:])))
        pair.append(-1)
        for i, rank in enumerate(pair):
            if rank >= 0:
                if rank in bucket:
                    self._enter_again(rank, i)
                else:
                    bucket[rank] = i
                    high = rank >> 8
                    leaf[high] |= 1 << (rank & 255)
                    top |= 1 << high
        while top:
            high = (top & -top).bit_length() - 1
            bits = leaf[high]
            rank = high << 8 | (bits & -bits).bit_length() - 1
            i = bucket[rank]
            if i.__class__ is list:
                i = heappop(held := i)
                if not held:
                    del bucket[rank]
            else:
                del bucket[rank]
            if rank not in bucket:
                bits &= bits - 1
                leaf[high] = bits
                if not bits:
                    top &= top - 1
            if pair[i] != rank:
                continue
            gone = after[i]
            after[i] = following = after[gone]
            token[i] = rank
            token[gone] = pair[gone] = -1
            if following < n:
                before[following] = i
                pair[i] = new = rank_of(rank << 24 | token[following], -1)
                if new >= 0:
                    if new in bucket:
                        self._enter_again(new, i)
                    else:
                        bucket[new] = i
                        high = new >> 8
                        leaf[high] |= 1 << (new & 255)
                        top |= 1 << high
            else:
                pair[i] = -1
            previous = before[i]
            if previous >= 0:
                pair[previous] = new = rank_of(token[previous] << 24 | rank, -1)
                if new >= 0:
                    if new in bucket:
                        self._enter_again(new, previous)
                    else:
                        bucket[new] = previous
                        high = new >> 8
                        leaf[high] |= 1 << (new & 255)
                        top |= 1 << high
        return [t for t in token if t >= 0]

    def _enter_again(self, rank: int, i: int) -> None:
        """Put a position into a bucket that holds others."""
        held = self.bucket[rank]
        if held.__class__ is list:
            heappush(held, i)
        else:
            self.bucket[rank] = [held, i] if held < i else [i, held]


class Cache(dict):
    """Two generations of results: what was asked for since the last change of generation stays."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, text: str) -> bytes:
        found = self.old.get(text)
        if found is None:
            found = self.make(text)
            if len(text) > CACHE_CHARS:
                return found
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[text] = found
        return found


class Encoder:
    """Whole texts to ids, and ids to bytes."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.queue = RankQueue(self.ranks)
        self.find = regex.compile(pattern).findall
        vocabulary = {rank: token for token, rank in self.ranks.items()}
        self.vocabulary = pa.array([vocabulary.get(r) for r in range(max(vocabulary, default=-1) + 1)], pa.large_binary())
        self.pre_token = Cache(lambda text: pack(f"<{len(ids := self.queue.encode(text.encode()))}I", *ids), CACHE_TOKENS).__getitem__

    def stretch(self, text: str) -> bytes:
        """Packed ids of a stretch of text that no pre-token leaves or enters."""
        return b"".join(map(self.pre_token, self.find(text)))

    #: A pre-token never runs from a character that is no white space into a space.
    _stretches = staticmethod(re.compile(r"(?<=\S)(?= )").split)

    def _spaced(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words with a space before each: one after another, and how many each has.

        A plain word's letters with the space are one pre-token and its marks another, so they need no pattern.
        """
        plain = flags(pc.match_substring_regex(words, PLAIN_WORD))
        letters, marks = letters_and_marks(words.filter(pa.array(plain)))
        parts, number = Parts(len(words)), lambda coded: coded.indices.to_numpy(zero_copy_only=False)
        parts.add(plain, 0, *_ids([self.pre_token(" " + w) for w in letters.dictionary.to_pylist()]), number(letters))
        parts.add(plain, 1, *_ids([self.pre_token(m) if m else b"" for m in marks.dictionary.to_pylist()]), number(marks))
        parts.add(~plain, 0, *_ids([self.stretch(" " + w) for w in words.filter(pa.array(~plain)).to_pylist()]))
        return parts.joined()

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin (and the last one's end).

        Texts with single spaces only are cut and coded by Arrow; others are taken apart one by one.
        """
        odd = flags(pc.match_substring_regex(texts, "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "))
        split = pc.split_pattern(pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts), " ")
        coded = split.flatten().dictionary_encode()
        codes, bounds = coded.indices.to_numpy(zero_copy_only=False), np.asarray(split.offsets, dtype=np.int64)
        bounds = bounds - bounds[0]
        first = bounds[:-1]  # the first word of a text has no space before it
        begin = [b"".join(map(self.stretch, self._stretches(texts[k].as_py()))) if other else self.stretch(coded.dictionary[int(codes[first[k]])].as_py()) for k, other in enumerate(odd.tolist())]
        ids, size = self._spaced(coded.dictionary)
        start, length = (np.cumsum(size) - size)[codes], size[codes]
        heads, head_sizes = _ids(begin)
        start[first], length[first] = len(ids) + np.cumsum(head_sizes) - head_sizes, head_sizes
        return gathered(np.concatenate([ids, heads]), start, length), np.r_[0, np.cumsum(length)][bounds]

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The bytes of each stretch of ids; an id without a token is an error."""
        if len(ids) and (int(ids.max()) >= len(self.vocabulary)):
            raise ValueError("an id has no token")
        tokens = self.vocabulary.take(pa.array(ids))
        if tokens.null_count:
            raise ValueError("an id has no token")
        _, offsets, data = tokens.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[tokens.offset : tokens.offset + len(ids) + 1][bounds]
        return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(at.tobytes()), data])


def _ids(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed ids as numbers, one after another, and how many each has."""
    return np.frombuffer(b"".join(packed), dtype="<u4"), np.fromiter(map(len, packed), np.int64, len(packed)) // 4


def _packed(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((4 * bounds).astype(np.int64).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])


def encoder(path: str, pattern: str) -> Encoder:
    return kept_in_worker(("bpe", path, pattern), lambda: Encoder(path, pattern))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """(id, ids binary, n_tokens long[, decoded binary]) for every row: the whole text as packed 32-bit ids.

    Null and empty texts give no ids; repeated rows and null ids give a row each; other columns are not read; a
    very long text is a slice of its own. ``path`` names a rank file that every executor can open, ``pattern``
    splits text into pre-tokens. With ``with_decoded`` the ids are decoded again in the same pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(path, pattern)
        for part in text_slices(batches, limit=SLICE_TEXT):
            ids, bounds = worker.texts(text_column(part))
            more = [worker.decoded(ids, bounds).cast(pa.binary())] if with_decoded else []
            yield pa.RecordBatch.from_arrays([part.column("id"), _packed(ids, bounds).cast(pa.binary()), pa.array(np.diff(bounds)), *more], ["id", "ids", "n_tokens", "decoded"][: 3 + with_decoded])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids binary, n_tokens bigint" + ", decoded binary" * with_decoded).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the bytes that packed ids stand for; null ids give null. An id without a token is an error."""
    kept = [c for c in df.columns if c != to]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(path, pattern)
        for part in text_slices(batches, ids_col):
            given = part.column(ids_col).to_pylist()
            ids, sizes = _ids([x or b"" for x in given])
            found = pc.if_else(part.column(ids_col).is_null(), None, worker.decoded(ids, np.r_[0, np.cumsum(sizes)]).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([*part.columns, found], [*kept, to])

    return df.select(kept).mapInArrow(run, f"{kinds}, `{to}` binary")
