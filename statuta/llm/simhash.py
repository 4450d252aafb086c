"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import blocks_of, cut, forest, group_starts, nothing_kept_in_worker, sorted_runs, text_column, text_slices, with_blocks
from statuta.llm.components import components

RADIUS = 3
#: Distinct fingerprints that meet under one key on average, at most; see ``parts_for``.
BUCKET_ROWS = 64
MOST_PARTS = 7
#: Fingerprints of one bucket that are compared in one block.
BLOCK_ROWS = 2048
#: Groups up to this size are compared together, many groups at a time.
SMALL = 16


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 hashes of the word shingles of one text, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
        starts = [0, *(spaces + 1).tolist()]
        ends = [*spaces.tolist(), len(joined)][shingle - 1 :]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends)]
    n = len(hashes)
    total = np.zeros(64, dtype=np.int64)
    values = np.array(hashes, dtype="<u8").view(np.uint8).reshape(n, 8)
    for first in range(0, n, 8192):
        total += np.unpackbits(values[first : first + 8192], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, bits long) for every row, from its whole text; null and empty texts have bits 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept_in_worker()
        for part in text_slices(batches):
            found = np.array([fingerprint(t, shingle, seed) for t in text_column(part).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found.view(np.int64))], ["id", "bits"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, bits bigint").withColumnRenamed("id", id_col)


def bit_planes(values: np.ndarray) -> list[int]:
    """64 whole numbers: bit i of the p-th is bit p of the i-th value."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(bits.T, axis=1, bitorder="little")]


def within(planes: list[int], shift: int, asked: int, radius: int) -> int:
    """Of the pairs (i, i + shift) whose bit i is set in ``asked``, those that differ in at most ``radius`` bits.

    One bitwise step handles all pairs: a carry-save counter (one whole number for each binary digit of the
    distance) takes up a plane's differences, and pairs past the radius leave ``asked``. When none is left the
    block is abandoned.
    """
    digits = [0] * max(1, radius.bit_length())
    for number, plane in enumerate(planes):
        carry = (plane ^ (plane >> shift)) & asked
        for d in range(len(digits)):
            digits[d], carry = digits[d] ^ carry, digits[d] & carry
        asked &= ~carry
        if number % 8 == 7 and not asked:
            return 0
    over = 0  # pairs whose counter is above the radius, for a radius that is no power of two less one
    equal = asked
    for d in reversed(range(len(digits))):
        if radius >> d & 1:
            equal &= digits[d]
        else:
            over |= equal & digits[d]
            equal &= ~digits[d]
    return asked & ~over


def set_bits(number: int) -> np.ndarray:
    if not number:
        return np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(number.to_bytes((number.bit_length() + 7) // 8, "little"), dtype=np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def _packed(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def linked(values: np.ndarray, group: np.ndarray, chunk: np.ndarray, same_chunk: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs inside runs of equal ``group``; small groups together, large ones each alone."""
    left, right = [], []
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    small = np.repeat(sizes <= SMALL, sizes)
    stretches = [(np.flatnonzero(small), min(SMALL, int(sizes.max(initial=1))))] if small.any() else []
    stretches += [(np.arange(s, s + n), int(n)) for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL])]
    for rows, most in stretches:
        planes = bit_planes(values[rows])
        g, c, same = group[rows], chunk[rows], same_chunk[rows]
        for shift in range(1, most):
            asked = np.zeros(len(rows), dtype=bool)
            asked[:-shift] = (g[shift:] == g[:-shift]) & (same[:-shift] | (c[shift:] != c[:-shift]))
            if asked.any() and len(found := set_bits(within(planes, shift, _packed(asked), radius))):
                left.append(rows[found])
                right.append(rows[found + shift])
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def parts_of(n: int) -> list[tuple[int, int]]:
    """(place, size) of n parts of 64 bits that are as even as possible, larger ones first."""
    sizes = [64 // n + (k < 64 % n) for k in range(n)]
    return [(sum(sizes[:k]), size) for k, size in enumerate(sizes)]


def parts_for(rows: int) -> int:
    """Parts that a fingerprint is cut into.

    Of fingerprints that differ in at most three bits all parts but three agree, and those that agree are the
    key: 25 bits of five parts (10 keys a row), 31 of six (20), 36 of seven (35). Every number of parts finds
    the same links; more of them keep the buckets of more rows small.
    """
    n = RADIUS + 2
    while n < MOST_PARTS and rows > BUCKET_ROWS << sum(size for _, size in parts_of(n)[RADIUS:]):
        n += 1
    return n


def near_edges(bits: DataFrame, radius: int = RADIUS, n_parts: int | None = None) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column bits) that connect all within the radius.

    Within a block only a forest of its links is returned (a row a fingerprint at most), which has the same
    components as all of them. The radius may be 0 to 3, and the parts are chosen for it by the number of rows.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError("the buckets hold all pairs for a radius from 0 to 3")
    parts = parts_of(parts_for(bits.count()) if n_parts is None else n_parts)
    value = F.col("bits")

    def part(at: int, size: int):
        return F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << size) - 1))

    keys = []
    for k, alike in enumerate(combinations(parts, len(parts) - RADIUS)):
        key = F.lit(0).cast("long")
        for at, size in alike:
            key = F.shiftleft(key, size).bitwiseOR(part(at, size))
        keys.append(key.bitwiseOR(F.lit(k << 56)))
    rows = bits.select("bits", F.explode(F.array(*keys)).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, ["key", "block_a", "block_b"]):
            starts = group_starts(table, ["key", "block_a", "block_b"])
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, table.num_rows]))
            values = table.column("bits").to_numpy()
            same = table.column("block_a").to_numpy() == table.column("block_b").to_numpy()
            left, right = linked(values, group, table.column("chunk").to_numpy(), same, radius)
            label = forest(len(values), left, right)
            other = np.flatnonzero(label != np.arange(len(values)))
            yield pa.RecordBatch.from_arrays([pa.array(values[other]), pa.array(values[label[other]])], ["u", "v"])

    return blocks_of(with_blocks(rows, ["key"], value, BLOCK_ROWS), ["key"]).select("key", "block_a", "block_b", "chunk", "bits").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(df: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, bits, fingerprint, component_id) for every row.

    component_id is the smallest id reachable by links of at most ``radius`` differing bits. Rows with equal
    fingerprints, such as exact copies, are one node from the start. Null and empty texts have fingerprint
    zero and link like any other, and texts of any length are hashed whole. Rows with a null id take part, but
    never name a component unless all its ids are null; repeated rows are returned as often as they occur. Other
    columns, whatever their names, are not read. An empty table gives an empty one.
    """
    own = cut(fingerprints(df, id_col, text_col, shingle))
    nodes = own.groupBy("bits").agg(F.min(id_col).alias("low"))
    roots = components(near_edges(nodes.select("bits"), radius))
    placed = nodes.join(roots, nodes["bits"] == roots["node"], "left").select("bits", "low", F.coalesce("root", "bits").alias("root"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.select("bits", "root").join(lows, "root").select("bits", "component_id")
    return own.join(named, "bits").select(id_col, "bits", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
