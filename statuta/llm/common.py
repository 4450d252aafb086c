"""Shared helpers of the training-data operators: lineage cuts, Arrow text slices, hot-group blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.lineage import cut  # noqa: F401  (operators take it from here)

#: Texts are handed to numpy in slices of about this many bytes, so that a task's memory
#: does not depend on how many rows Spark puts into an Arrow batch.
SLICE_BYTES = 4 << 20


#: Plain words: letters that stay single letters when normalised and lower-cased, then ASCII marks (no apostrophe).
#: Tokenizers' patterns part both, so letters and marks can be encoded apart, each distinct one once.
LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ɏΑ-ΡΣ-Ωα-ωЀ-џ"
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
PLAIN_WORD = rf"^[{LETTERS}]+[!-&(-/:-@\[-`{{-~]*$"

_worker: dict = {}


def kept_in_worker(key: tuple, make: Callable):
    """What ``make()`` gives, kept over the tasks of a Python worker as long as they ask for the same key.

    A worker serves one operator after another; the caches of the last one go when the next comes.
    """
    if key not in _worker:
        nothing_kept_in_worker()
        _worker[key] = make()
    return _worker[key]


def nothing_kept_in_worker() -> None:
    """Give back what earlier operators left in this Python worker; for operators that keep nothing themselves."""
    _worker.clear()
    pa.default_memory_pool().release_unused()


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first, total = 0, 0
        for row, size in enumerate(sizes):
            if row > first and total + size > limit:
                yield batch.slice(first, row - first)
                first, total = row, 0
            total += size
        if len(sizes) > first:
            yield batch.slice(first)


def text_column(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column of a batch as strings, null as the empty text."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def flags(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False).astype(bool)


def letters_and_marks(words: pa.Array, lower: bool = False) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
    """Both parts of plain words, coded; the letters in lower case if asked for."""
    letters = pc.ascii_rtrim(words, MARKS)
    return (pc.utf8_lower(letters) if lower else letters).dictionary_encode(), pc.replace_substring_regex(words, f"^[{LETTERS}]+", "").dictionary_encode()


def gathered(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of values that begin at ``start``, one after another."""
    ends = np.cumsum(length)
    return values[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


class Parts:
    """Ids of words that are made of up to two parts, each encoded once."""

    def __init__(self, words: int):
        self.place = np.zeros((words, 2, 2), dtype=np.int64)
        self.held, self.at = [], 0

    def add(self, rows: np.ndarray, part: int, ids: np.ndarray, size: np.ndarray, codes: np.ndarray | None = None) -> None:
        """Ids of distinct parts, one after another, with their sizes; codes say which one each row has."""
        start = self.at + np.cumsum(size) - size
        self.place[rows, part, 0] = start if codes is None else start[codes]
        self.place[rows, part, 1] = size if codes is None else size[codes]
        self.held.append(ids)
        self.at += len(ids)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        return gathered(ids, self.place[..., 0].ravel(), self.place[..., 1].ravel()), self.place[..., 1].sum(axis=1)


def coded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words between ASCII white space: distinct words, their code at each place, and each text's first place.

    Empty strings (leading or trailing white space) stay as words, since a caller may count or skip them.
    """
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    offsets = np.asarray(split.offsets, dtype=np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]


def with_blocks(rows: DataFrame, key: list[str], item: Column, limit: int) -> DataFrame:
    """Prepare an all-pairs job inside groups without ever gathering a large group in one task.

    Groups of one row are dropped. A group of n rows is dealt into ``ceil(n / limit)`` chunks by a hash of
    ``item``, and each row goes to every pair of chunks (``block_a <= block_b``) that holds its own one
    (``chunk``), so each pair of rows meets in exactly one block, whose size stays around twice ``limit``.
    """
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("group_rows")).where("group_rows > 1")
    n = F.ceil(F.col("group_rows") / F.lit(limit)).cast("int")
    return (
        rows.join(sizes, key)
        .withColumn("chunks", n)
        .withColumn("chunk", F.pmod(F.xxhash64(item), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("block_a", F.least("chunk", "other"))
        .withColumn("block_b", F.greatest("chunk", "other"))
        .drop("group_rows", "chunks", "other")
    )


def sorted_runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """From batches sorted by ``key``, tables that each hold whole groups; the last, open group waits for more rows."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = group_starts(pa.Table.from_batches([batch]), key)
        if kept:
            joint = pa.Table.from_batches([kept[-1].slice(kept[-1].num_rows - 1), batch.slice(0, 1)])
            first = 0 if len(group_starts(joint, key)) > 1 else None
        else:
            first = None
        last = changed[-1] if len(changed) > 1 else 0
        if last:
            yield pa.Table.from_batches([*kept, batch.slice(0, last)])
            kept = [batch.slice(last)]
        elif first == 0:
            yield pa.Table.from_batches(kept)
            kept = [batch]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def group_starts(table: pa.Table, key: list[str]) -> np.ndarray:
    """First row of each run of equal key values."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for name in key:
        values = table.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def blocks_of(df: DataFrame, key: list[str]) -> DataFrame:
    """Bring the rows of each block together, ordered, so that a task can stream over its blocks."""
    by = [*key, "block_a", "block_b"]
    return df.repartition(*by).sortWithinPartitions(*by)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Label n nodes with the smallest node that they reach through the given links (numpy label passing)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def shards_for(rows: int, per_shard: int) -> int:
    return max(1, math.ceil(rows / per_shard))
