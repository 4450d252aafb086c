"""Removal of word windows that an earlier document has, by super-k-mer partitioning (operator 7)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import nothing_kept_in_worker, text_column, text_slices

#: Text bytes that meet in one bucket, about; buckets follow the size of the corpus.
BUCKET_BYTES = 8 << 20
#: Bytes of packed strings that a task gathers before it sends a row to each bucket.
FLUSH_BYTES = 16 << 20
SLICE = 1 << 20
#: A minimiser with this share of a bucket's windows is hot: its windows go to buckets by their own hash. It is
#: recognised by the documents whose id's hash is a multiple of ONE_IN, as a range partitioner finds its bounds by
#: sampling: this changes where windows meet and never whether they do.
HOT_SHARE, ONE_IN, BYTES_PER_WINDOW = 0.25, 64, 6
#: Words of a minimiser, and odd multipliers of the rolling hashes (fixed, arbitrary).
MINIMISER_WORDS = 2
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as long as needed; tables of long texts are not kept."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up[:n], self.down[:n]
        made = []
        for base in (self.base, self.inverse):
            table = np.full(n, base, dtype=np.uint64)
            table[:1] = 1
            made.append(np.multiply.accumulate(table))
        if n <= 2 * SLICE:
            self.up, self.down = made
        return made[0], made[1]


_BYTES, _WORDS = _Powers(BYTE_BASE), _Powers(WORD_BASE)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xCF1BBCDCBFA56385)
    x ^= x >> np.uint64(29)
    return x


def _range_hashes(values: np.ndarray, first: np.ndarray, end: np.ndarray, powers: _Powers) -> np.ndarray:
    """Polynomial hashes of values[first:end], the same wherever the values stand."""
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return _mix((sums[end] - sums[first]) * down[first])


def word_table(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of single-spaced words, joined by newlines: each word's start, end, text number and hash."""
    raw = np.frombuffer(joined, dtype=np.uint8)
    gaps = np.flatnonzero((raw == 32) | (raw == 10))
    start, end = np.r_[0, gaps + 1], np.r_[gaps, len(raw)]
    number = np.r_[0, np.cumsum(raw[gaps] == 10)]
    return start, end, number, _range_hashes(raw.astype(np.uint64), start, end, _BYTES)


def super_kmers(number: np.ndarray, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and minimiser of each run of consecutive windows that share a minimiser."""
    n = len(number) - window + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),)
    width = window - MINIMISER_WORDS + 1
    low = _mix(hashes[:-1] * np.uint64(3) + hashes[1:] * np.uint64(0x2545F4914F6CDD1D))
    have = 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    valid = np.flatnonzero(number[:n] == number[window - 1 :])
    low = low[valid]
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(valid)] - 1
    return valid[first], valid[last] if len(valid) else last[:0], low[first]


def _pack(arrays: list[np.ndarray], squeeze) -> bytes:
    """Counts, then numbers of growing size, as differences; mostly zeros, which compress well."""
    return squeeze(b"".join(np.r_[x[:1], np.diff(x)].astype("<i8").reshape(-1, 1).view(np.uint8).T.tobytes() for x in arrays))


def _unpack(data: bytes, sizes: list[int]) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(zstandard.decompress(data), dtype=np.uint8), [], 0
    for n in sizes:
        out.append(np.cumsum(np.ascontiguousarray(raw[at : at + 8 * n].reshape(8, n).T).view("<i8").ravel()))
        at += 8 * n
    return out


def _joined(part: pa.RecordBatch, window: int) -> tuple[bytes, list, list]:
    """Texts of a slice that have a window, single-spaced and joined by newlines; their ids and text keys."""
    texts, ids, keys = [], [], []
    for doc_id, text in zip(part.column("id").to_pylist(), text_column(part).to_pylist()):
        raw = text.encode()
        words = raw.split()
        if len(words) >= window and doc_id is not None:
            texts.append(b" ".join(words))
            ids.append(doc_id)
            keys.append(xxhash.xxh64_intdigest(raw, 42) & 0xFFFFFFFF)
    return b"\n".join(texts), ids, keys


def hot_minimisers(rows: DataFrame, window: int, least: int) -> np.ndarray:
    """Minimisers of ``least`` windows or more, sorted: at most all windows divided by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept_in_worker()
        for part in text_slices(batches, limit=SLICE):
            joined, ids, _ = _joined(part, window)
            if ids:
                _, _, number, hashes = word_table(joined)
                first, last, low = super_kmers(number, hashes, window)
                key, at = np.unique(low, return_inverse=True)
                n = np.bincount(at, last - first + 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["low", "n"])

    counts = rows.mapInArrow(run, "low bigint, n bigint").groupBy("low").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["low"] for r in counts.select("low").collect()], dtype=np.int64).view(np.uint64))


def _packed_strings(rows: DataFrame, window: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Rows (bucket, strings, texts, runs, places, data, who): the super-k-mers of a stretch of documents, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept_in_worker()
        squeeze = zstandard.ZstdCompressor(level=3).compress
        held: dict[int, list] = defaultdict(list)

        def flush() -> pa.RecordBatch:
            out = []
            for bucket, parts in held.items():
                strings = [s for p in parts for s in p[0]]
                repeats, ids, keys, at = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3, 4))
                # Runs of occurrences in one document share its id and key.
                new = np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]
                runs = np.diff(np.r_[np.flatnonzero(new), len(ids)])
                who = _pack([repeats, ids[new], runs, at], squeeze)
                out.append((bucket, len(strings), len(runs), len(at), squeeze(b"\n".join(strings)), who, keys[new].astype("<u4").tobytes()))
            held.clear()
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["bucket", "strings", "runs", "places", "data", "who", "text_keys"])

        size = 0
        for part in text_slices(batches, limit=SLICE):
            joined, ids, keys = _joined(part, window)
            if not ids:
                continue
            start, end, number, hashes = word_table(joined)
            first, last, low = super_kmers(number, hashes, window)
            is_hot = np.isin(low, hot)
            if is_hot.any():  # one string for each window
                times = np.where(is_hot, last - first + 1, 1)
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                first, last, low, is_hot = np.repeat(first, times) + nth, np.repeat(last, times), np.repeat(low, times), np.repeat(is_hot, times)
                last = np.where(is_hot, first, last)
            a, b = start[first], end[last + window - 1]
            own = _range_hashes(np.frombuffer(joined, dtype=np.uint8).astype(np.uint64), a, b, _BYTES)
            bucket = (_mix(np.where(is_hot, own, low) ^ np.uint64(BYTE_BASE)) % np.uint64(buckets)).astype(np.int64)
            # The same string in many places of this stretch travels once, with all its places.
            order = np.lexsort((first, own, bucket))
            new = np.r_[True, own[order][1:] != own[order][:-1]]
            heads = order[new]
            repeats = np.diff(np.r_[np.flatnonzero(new), len(order)])
            text_first = np.r_[0, np.cumsum(np.bincount(number))][:-1]
            doc = number[first[order]]
            ids_, keys_, at = np.array(ids, dtype=np.int64)[doc], np.array(keys, dtype=np.int64)[doc], first[order] - text_first[doc]
            cuts = np.flatnonzero(np.r_[True, bucket[heads][1:] != bucket[heads][:-1]])
            places = np.r_[0, np.cumsum(repeats)]
            lefts, rights = a[heads].tolist(), b[heads].tolist()
            for x, y in zip(cuts.tolist(), np.r_[cuts[1:], len(heads)].tolist()):
                strings = [joined[p:q] for p, q in zip(lefts[x:y], rights[x:y])]
                w = slice(places[x], places[y])
                held[int(bucket[heads[x]])].append((strings, repeats[x:y], ids_[w], keys_[w], at[w]))
            size += int((b[heads] - a[heads]).sum()) + 24 * len(order)
            if size >= FLUSH_BYTES:
                yield flush()
                size = 0
        if held:
            yield flush()

    return rows.mapInArrow(run, "bucket int, strings int, runs int, places int, data binary, who binary, text_keys binary")


def _unequal(raw: np.ndarray, left: np.ndarray, right: np.ndarray, size_left: np.ndarray, size_right: np.ndarray) -> np.ndarray:
    """Which pairs of stretches of raw differ."""
    out = size_left != size_right
    for at in range(0, len(left), 1 << 16):
        k = slice(at, at + (1 << 16))
        n = np.where(out[k], 0, size_left[k])
        ends = np.cumsum(n)
        step = np.arange(ends[-1] if len(ends) else 0)
        differ = raw[np.repeat(left[k] - (ends - n), n) + step] != raw[np.repeat(right[k] - (ends - n), n) + step]
        out[k] |= np.bincount(np.repeat(np.arange(len(n)), n)[differ], minlength=len(n)) > 0
    return out


class _Bucket:
    """Windows of one bucket: a hash, a string and its bytes for each; places of the strings."""

    def __init__(self, window: int):
        self.window = window
        self.hashes, self.string, self.local, self.begin, self.size, self.repeats, self.ids, self.keys, self.at, self.data = ([] for _ in range(10))
        self.strings = self.bytes = 0

    def add(self, row: dict) -> None:
        repeats, ids, runs, at = _unpack(row["who"], [row["strings"], row["runs"], row["runs"], row["places"]])
        keys = np.frombuffer(row["text_keys"], dtype="<u4").astype(np.int64)
        data = zstandard.decompress(row["data"])
        start, end, number, hashes = word_table(data)
        n = len(number) - self.window + 1
        valid = np.flatnonzero(number[:n] == number[self.window - 1 :])
        self.hashes.append(_range_hashes(hashes, valid, valid + self.window, _WORDS))
        first = np.r_[0, np.cumsum(np.bincount(number))][:-1]
        self.local.append((valid - first[number[valid]]).astype(np.int32))
        self.string.append((number[valid] + self.strings).astype(np.int32))
        self.begin.append(start[valid] + self.bytes)
        self.size.append((end[valid + self.window - 1] - start[valid]).astype(np.int32))
        self.strings += row["strings"]
        self.bytes += len(data)
        self.data.append(data)
        self.repeats.append(repeats.astype(np.int32))
        self.ids.append(np.repeat(ids, runs))
        self.keys.append(np.repeat(keys, runs).astype(np.uint32))
        self.at.append(at.astype(np.int32))

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """Order of the windows by hash, and the first of each run of equal words.

        Runs of one hash are compared byte by byte; where two windows differ, all that differ from their
        neighbour get another hash, until every run holds one window's words only.
        """
        hashes, begin, size = (np.concatenate(x) for x in (self.hashes, self.begin, self.size))
        raw = np.frombuffer(b"".join(self.data), dtype=np.uint8)
        for seed in range(1, 65):
            order = np.argsort(hashes, kind="stable")
            ranked = hashes[order]
            same = np.flatnonzero(ranked[1:] == ranked[:-1])
            x, y = order[same], order[same + 1]
            wrong = _unequal(raw, begin[x], begin[y], size[x], size[y])
            if not wrong.any():
                return order, np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
            for k in np.flatnonzero(np.isin(hashes, hashes[y[wrong]])).tolist():
                hashes[k] = xxhash.xxh64_intdigest(raw[begin[k] : begin[k] + size[k]].tobytes(), seed)
        raise RuntimeError("windows could not be told apart")

    def spans(self) -> Iterator[pa.RecordBatch]:
        order, heads = self._sorted()
        self.hashes, self.begin, self.size, self.data = [], [], [], []
        string, local, repeats, ids, keys, at = (np.concatenate(x) for x in (self.string, self.local, self.repeats, self.ids, self.keys, self.at))
        first_place = np.r_[0, np.cumsum(repeats)]
        least = np.minimum.reduceat(ids, first_place[:-1])
        most = np.maximum.reduceat(ids, first_place[:-1])
        lowest = np.minimum.reduceat(least[string[order]], heads)
        earliest = np.empty(len(order), dtype=np.int64)
        earliest[order] = np.repeat(lowest, np.diff(np.r_[heads, len(order)]))
        found = np.flatnonzero(earliest < most[string])
        weight = np.cumsum(repeats[string[found]].astype(np.int64))
        for a, b in _even_cuts(weight, 1 << 20, string[found]):
            some = found[a:b]
            times = repeats[string[some]].astype(np.int64)
            window = np.repeat(some, times)
            place = np.repeat(first_place[string[some]], times) + (np.arange(len(window)) - np.repeat(np.cumsum(times) - times, times))
            later = earliest[window] < ids[place]
            window, place = window[later], place[later]
            by = np.lexsort((window, place))
            window, place = window[by], place[by]
            if not len(window):
                continue
            new = np.r_[True, (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)]
            head = np.flatnonzero(new)
            size = np.diff(np.r_[head, len(window)]) + self.window - 1
            p = place[head]
            yield pa.RecordBatch.from_arrays([pa.array(ids[p]), pa.array(keys[p].astype(np.int64)), pa.array(at[p] + local[window[head]], pa.int32()), pa.array(size, pa.int32())], ["id", "text_key", "first", "words"])


def _even_cuts(weight: np.ndarray, most: int, string: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``most`` weight that end where a string ends (or hold one string's windows)."""
    a, n = 0, len(weight)
    while a < n:
        b = int(np.searchsorted(weight, (weight[a - 1] if a else 0) + most))
        b = max(b, a + 1)
        while b < n and string[b] == string[b - 1]:
            b += 1
        yield a, min(b, n)
        a = min(b, n)


def repeated_spans(df: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, first int, words int): stretches of words whose windows an earlier document also has.

    Consecutive windows that share a minimiser (the least hash of their word pairs) travel as one string to
    the minimiser's bucket, compressed with their documents; a bucket sorts its windows, compares the words of
    equal hashes, and finds the least document of each. Windows of a hot minimiser are dealt by their own words,
    so that only equal ones must meet. A string that many documents of a stretch share travels once. text_key tells rows
    with the same id but other text apart. Rows with a null id or fewer words give nothing; ids are whole numbers
    or strings of them (others are null). A very long text is a slice of its own; other columns are not read.
    """
    rows = df.select(F.col(id_col).try_cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 2 * max(partitions, -(-total // BUCKET_BYTES))  # a task has any number of them, one after another

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, now = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                if row["bucket"] != now:
                    if bucket is not None:
                        yield from bucket.spans()
                    bucket, now = _Bucket(window), row["bucket"]
                bucket.add(row)
        if bucket is not None:
            yield from bucket.spans()

    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(ONE_IN)) == 0)
    hot = hot_minimisers(some, window, max(1, int(HOT_SHARE * BUCKET_BYTES / BYTES_PER_WINDOW / ONE_IN)))
    packed = _packed_strings(rows, window, buckets, hot)
    return packed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "id bigint, text_key bigint, first int, words int")


def remove_repeats(df: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None, layout: bool = False) -> DataFrame:
    """(id, n_words long, n_removed long, kept string[, carried column]) for every row.

    Words are maximal runs without ASCII white space; kept is what is left, joined by single spaces. Windows
    are judged on the input. Null, empty and short texts lose nothing; repeated rows and rows that share an
    id do not count as earlier than each other; a null id is earlier than none and later than none. With
    ``layout`` a text that loses nothing stays as it is, a null one null.
    """
    spans = repeated_spans(df, window, id_col, text_col).groupBy("id", "text_key").agg(F.collect_list(F.struct("first", "words")).alias("spans"))
    own = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.col(id_col).try_cast("bigint").alias("number"), own.alias("text"), F.xxhash64(own).bitwiseAND(F.lit(0xFFFFFFFF)).alias("text_key"), *([F.col(carry).alias("carried")] if carry else []))
    more = ["carried"] if carry else []
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ["id", *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            n_words, n_removed, kept = [], [], []
            for text, gone in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                words = (text or "").encode().split()
                n_words.append(len(words))
                if gone:
                    change = np.zeros(len(words) + 1, dtype=np.int32)
                    first = np.array([s["first"] for s in gone])
                    np.add.at(change, first, 1)
                    np.add.at(change, first + np.array([s["words"] for s in gone]), -1)
                    stay = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
                    words = [words[i] for i in stay]
                n_removed.append(n_words[-1] - len(words))
                kept.append(text if layout and not gone else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ["id", *more]), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["id", *more, "n_words", "n_removed", "kept"])

    found = rows.join(spans.withColumnRenamed("id", "number"), ["number", "text_key"], "left").select("id", *more, "text", "spans")
    out = found.mapInArrow(run, f"{kinds}, n_words bigint, n_removed bigint, kept string").withColumnRenamed("id", id_col)
    return out.withColumnRenamed("carried", carry) if carry else out
