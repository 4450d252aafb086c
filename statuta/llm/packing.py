"""Best-fit packing of tokenized documents into fixed-length sequences, improved by swaps (operator 2)."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import PLAIN_WORD, Parts, cut, flags, gathered, kept_in_worker, letters_and_marks, shards_for, text_column, text_slices

#: Bytes of text whose distinct words are encoded together.
SLICE_TEXT = 6 << 20
#: What a special token's string has in it, so that such words go to the library alone.
SPECIAL = "<|"
#: Documents that one task packs together; hashing makes all shards alike.
SHARD_DOCUMENTS = 40_000


class WordTokenizer:
    """A tokenizers file whose words end at white space: each distinct word of a slice is encoded once by the library.

    Plain words go to it in one long text; the tokens with the word-end suffix tell them apart. Nothing is
    remembered from slice to slice, so memory follows the slice alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, dtype=bool)
        if suffix:
            for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.ends[number] = token.endswith(suffix)
        self.joined = bool(suffix)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        held, sizes = [], np.zeros(len(words), dtype=np.int64)
        for first in range(0, len(words), 4096):
            some = self._ids(words[first : first + 4096])
            sizes[first : first + len(some)] = [len(x) for x in some]
            held.append(np.fromiter(chain.from_iterable(some), dtype=np.uint32))
        return (np.concatenate(held) if held else np.zeros(0, np.uint32)), sizes

    def _together(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone; where their ends do not add up, they are encoded one by one."""
        held, sizes = [], np.zeros(len(words), dtype=np.int64)
        for first in range(0, len(words), 8192):
            listed = words.slice(first, 8192).to_pylist()
            ids = np.array(self._ids([" ".join(listed)])[0], dtype=np.uint32)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(listed):
                sizes[first : first + len(listed)] = np.diff(last, prepend=0)
            else:
                ids, sizes[first : first + len(listed)] = self._alone(listed)
            held.append(ids)
        return (np.concatenate(held) if held else np.zeros(0, np.uint32)), sizes

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after another, and how many each has."""
        plain = flags(pc.match_substring_regex(words, PLAIN_WORD)) & ~flags(pc.match_substring(words, SPECIAL)) if self.joined else np.zeros(len(words), dtype=bool)
        easy, parts = words.filter(pa.array(plain)), Parts(len(words))
        letters, marks = letters_and_marks(easy, lower=True)
        parts.add(plain, 0, *self._together(letters.dictionary), letters.indices.to_numpy(zero_copy_only=False))
        parts.add(plain, 1, *self._alone(marks.dictionary.to_pylist()), marks.indices.to_numpy(zero_copy_only=False))
        parts.add(~plain, 0, *self._alone(words.filter(pa.array(~plain)).to_pylist()))
        return parts.joined()

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin (and the last one's end)."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        codes, offsets = coded.indices.to_numpy(zero_copy_only=False), np.asarray(split.offsets, dtype=np.int64)
        ids, size = self._words(coded.dictionary)
        length = size[codes]
        return gathered(ids, (np.cumsum(size) - size)[codes], length), np.r_[0, np.cumsum(length)][offsets - offsets[0]]


def word_tokenizer(path: str) -> WordTokenizer:
    return kept_in_worker(("words", path), lambda: WordTokenizer(path))


def pieces(df: DataFrame, path: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenize whole texts and cut only those longer than ``length``.

    Returns (id, piece int, start long, length long, ids_crc32 long[, ids binary]), the document's ids being
    those of its text and ``end_id`` after them, as the library gives them without added special tokens (the
    string of a special token in a text is that token). Null and empty texts give one piece that holds
    ``end_id`` alone. Repeated rows give their pieces again, null ids keep theirs; other columns are not read.
    A very long text is a slice of its own. The text must be one whose tokens never cross white space (the
    case for the word-level BPE files that this is meant for).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, tail = word_tokenizer(path), np.array([end_id], dtype="<u4").tobytes()
        for part in text_slices(batches, limit=SLICE_TEXT):
            found, bounds = tokenizer.texts(text_column(part))
            sizes = np.diff(bounds) + 1
            count = -(-sizes // length)
            rows = np.repeat(np.arange(part.num_rows), count)
            number = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
            start = number * length
            size = np.minimum(length, sizes[rows] - start)
            view, first = memoryview(found.astype("<u4").tobytes()), bounds[:-1][rows] + start
            last = number == count[rows] - 1
            blocks = [view[4 * a : 4 * (a + n - 1)] if end else view[4 * a : 4 * (a + n)] for a, n, end in zip(first.tolist(), size.tolist(), last.tolist())]
            crc = [zlib.crc32(tail, zlib.crc32(x)) if end else zlib.crc32(x) for x, end in zip(blocks, last.tolist())]
            columns = [part.column("id").take(pa.array(rows)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            more = [pa.array([bytes(x) + tail if end else bytes(x) for x, end in zip(blocks, last.tolist())], pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns + more, ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids).withColumnRenamed("id", id_col)


class _Levels:
    """Lists of entries by a whole number, with a bitmap that finds the first filled one at or above a number."""

    def __init__(self, most: int):
        self.lists: list[list] = [[] for _ in range(most + 1)]
        self.bits = 0

    def add(self, at: int, entry) -> None:
        self.lists[at].append(entry)
        self.bits |= 1 << at

    def first(self, least: int) -> int:
        rest = self.bits >> least
        return least + (rest & -rest).bit_length() - 1 if rest else -1

    def last_entry(self, at: int, valid) -> object:
        """The newest valid entry; stale ones go."""
        held = self.lists[at]
        while held and not valid(held[-1]):
            held.pop()
        if not held:
            self.bits &= ~(1 << at)
            return None
        return held[-1]


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: the longest first, each into the fullest bin with room for it."""
    free_bins, bins = _Levels(capacity), []
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        at = free_bins.first(size)
        if at < 0:
            bins.append([item])
            left, own = capacity - size, len(bins) - 1
        else:
            own = free_bins.lists[at].pop()
            if not free_bins.lists[at]:
                free_bins.bits &= ~(1 << at)
            bins[own].append(item)
            left = at - size
        if left:
            free_bins.add(left, own)
    return bins


class _Places(_Levels):
    """Levels whose lists are heaps, so that the least entry of a level comes first."""

    def add(self, at: int, entry) -> None:
        heappush(self.lists[at], entry)
        self.bits |= 1 << at

    def least(self, at: int, valid) -> object:
        """The least valid entry; stale ones before it go."""
        held = self.lists[at]
        while held and not valid(held[0]):
            heappop(held)
        if not held:
            self.bits &= ~(1 << at)
            return None
        return held[0]


def swap_search(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Local search over underfull bins until no change helps; every change raises the sum of squared fills.

    Bins are visited from the emptiest on, again and again. A visited bin's document moves into another bin, one
    is exchanged for a shorter one, or two are exchanged for one shorter than both together: each time into the
    fullest bin that has room. An emptied bin goes. The search ends when no bin has such a change left, since the
    sum of squared fills is whole, grows with each and is bounded. Documents of equal length stand for each other,
    and a bin has under sqrt(2 capacity) different lengths, so all its ones and twos are tried.
    """
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    where = {i: k for k, b in enumerate(bins) for i in b}
    #: Bins by room; documents, the shortest first, by what could take their place (their length and their bin's room).
    rooms, places = _Levels(capacity), _Places(capacity)

    def enter(k: int) -> None:
        if 0 < fill[k] < capacity:
            rooms.add(capacity - fill[k], k)
            for i in bins[k]:
                places.add(size[i] + capacity - fill[k], (size[i], i))

    def offers(k: int) -> list[tuple[int, tuple[int, ...]]]:
        """What the bin can give: its lengths, then the sums of two, each once and the longest first."""
        of: dict[int, list[int]] = {}
        for i in bins[k]:
            of.setdefault(size[i], []).append(i)
        each = sorted(of, reverse=True)
        twos = {x + y: (of[x][0], of[y][x == y]) for n, x in enumerate(each) for y in each[n:] if x != y or len(of[x]) > 1}
        return [(x, (of[x][0],)) for x in each] + sorted(twos.items(), reverse=True)

    def change(poor: int) -> tuple[int, tuple[int, ...], int | None] | None:
        """Bin that receives, documents that go there and the one that comes back, if any."""
        given = offers(poor)
        for total, out in given:
            if len(out) > 1:
                break
            at = rooms.first(total)
            while 0 <= at < capacity + total - fill[poor]:
                k = rooms.last_entry(at, lambda k: capacity - fill[k] == at and k != poor)
                if k is not None:
                    return k, out, None
                at = rooms.first(at + 1)
        for total, out in given:
            at = places.first(total)
            while 0 <= at < capacity + total - fill[poor]:
                found = places.least(at, lambda e: where[e[1]] != poor and e[0] + capacity - fill[where[e[1]]] == at)
                if found and found[0] < total:
                    return where[found[1]], out, found[1]
                at = places.first(at + 1)
        return None

    for k in sorted(range(len(bins)), key=lambda k: -fill[k]):
        enter(k)
    changed = True
    while changed:
        changed = False
        for poor in sorted((k for k in range(len(bins)) if 0 < fill[k] < capacity), key=lambda k: fill[k]):
            while bins[poor] and fill[poor] < capacity and (found := change(poor)):
                k, out, back = found
                for i in out:
                    bins[poor].remove(i)
                    bins[k].append(i)
                    where[i] = k
                if back is not None:
                    bins[k].remove(back)
                    bins[poor].append(back)
                    where[back] = poor
                net = sum(size[i] for i in out) - (0 if back is None else size[back])
                fill[k] += net
                fill[poor] -= net
                enter(k)
                changed = True
            enter(poor)  # its entries were stale while it was visited
    return [b for b in bins if b]


def pack(parts: DataFrame, documents: int, length: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to rows of (id, piece, length), each length from 1 to ``length``.

    Rows are dealt by a hash into shards of about SHARD_DOCUMENTS documents (``documents`` is their count);
    a shard is packed by best fit and then by ``swap_search``. A shard wastes about one sequence at most, so
    the whole stays within one sequence in ten thousand of what one task would reach. An empty table gives
    an empty one; null ids and repeated rows are packed like others.
    """
    shards = shards_for(documents, SHARD_DOCUMENTS)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([id_col, "piece", "length"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy()
        whole = lengths >= length
        small = np.flatnonzero(~whole)
        bins = best_fit(lengths[small], length)
        bins = swap_search(lengths[small], bins, length)
        sequence, offset = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        for number, held in enumerate(bins):
            items = small[np.sort(np.array(held))]
            sequence[items] = number
            offset[items] = np.cumsum(lengths[items]) - lengths[items]
        sequence[whole] = len(bins) + np.arange(whole.sum())
        shard = int(rows["shard"].iloc[0])
        return rows.drop(columns="shard").assign(sequence_id=(shard << 40) + sequence, offset=offset)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64(id_col, "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(df: DataFrame, path: str, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack: (id, piece, start, length, ids_crc32, sequence_id, offset)."""
    found = cut(pieces(df, path, length, id_col=id_col, text_col=text_col))
    return pack(found, found.count(), length, id_col)
