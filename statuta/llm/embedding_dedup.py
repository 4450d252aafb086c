"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import cut, forest, group_starts, sorted_runs, with_blocks
from statuta.llm.components import components

#: The rotation is learned from at most this many vectors, the first in the order of a hash of their id.
SAMPLE_ROWS = 20_000
QUANTISATION_ROUNDS = 40
#: Bits of a code that one Hamming table indexes.
TABLE_BITS = 16
#: Probes of one vector in one table; a vector that needs more is compared with its whole label instead.
MOST_PROBES = 8192
#: Vectors of one bucket that are compared in one block.
BLOCK_ROWS = 256
WIDE = -1
SLACK = 1e-6


def learn(vectors: np.ndarray, rounds: int = QUANTISATION_ROUNDS, seed: int = 3) -> np.ndarray:
    """Orthogonal rotation (principal axes turned by iterative quantisation) of unit vectors.

    All axes stay, so distances are the same before and after. The axes are those around the origin: taking
    the mean off would bring members of a dominant cluster close to zero, where every sign is uncertain.
    """
    d = vectors.shape[1]
    _, axes = np.linalg.eigh(vectors.T @ vectors)
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    own = vectors @ axes
    for _ in range(rounds):
        code = np.where(own @ turn >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(own.T @ code)
        turn = u @ vt
    return axes @ turn


def probes(z: np.ndarray, budget: float) -> list[int] | None:
    """Codes of one table that a neighbour may share: the own bits with every set of cheap bits flipped.

    Bit i costs z[i]**2; a set may cost ``budget``. None if there are more than MOST_PROBES.
    """
    code = int(((z >= 0).astype(np.int64) << np.arange(len(z))).sum())
    found = [(code, 0.0)]
    for i in np.argsort(z * z, kind="stable").tolist():
        cost = float(z[i]) ** 2
        if cost > budget:
            break
        found += [(c ^ (1 << i), spent + cost) for c, spent in found if spent + cost <= budget]
        if len(found) > MOST_PROBES:
            return None
    return [c for c, _ in found]


def shared(a: np.ndarray, b: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of pairs in one table: whether their common code is probed by both, and that code.

    Where signs differ the side nearer to zero flips, so the common code has the sign of the larger value.
    """
    differ = (a >= 0) != (b >= 0)
    a_flips = differ & (np.abs(a) <= np.abs(b))
    b_flips = differ & ~a_flips
    within = ((a.astype(float) ** 2 * a_flips).sum(axis=1) <= budget) & ((b.astype(float) ** 2 * b_flips).sum(axis=1) <= budget)
    bits = np.where(a_flips, b, a) >= 0
    return within, (bits.astype(np.int64) << np.arange(a.shape[1])).sum(axis=1)


def near_duplicates(df: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links long, component_id, kept) for every row.

    Rows are compared when their labels are equal and not null and their vectors equally long; a link is a
    cosine of at least ``least`` in double precision. Equal vectors are one class from the start. Each
    vector's binary code (signs after the learned rotation) is cut into tables of TABLE_BITS bits. At the
    limit two unit vectors are sqrt(2 - 2 least) apart, so in one table at least their distance is within an
    even share, and differing bits are bits where both are near zero: probing all cheap flips from both
    sides therefore finds every link. A pair met in several tables counts in the first. Null, zero and
    non-finite vectors, and rows with a null id, link with nothing; such rows have component_id = id and are
    kept. Repeated rows count as other vectors.
    """
    if not 0 < least <= 1:
        raise ValueError("the least cosine must be above 0")
    distance = 2 - 2 * least
    element = "double" if df.schema[vector_col].dataType.simpleString() == "array<double>" else "float"
    source = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{element}>").alias("vector"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    valid = source.where(sound)
    sample = [r["vector"] for r in valid.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vector").collect()]
    models = {}
    if sample:
        d = max({len(v) for v in sample}, key=lambda n: sum(len(v) == n for v in sample))
        x = np.array([v for v in sample if len(v) == d], dtype=float)
        models[d] = learn(x / np.linalg.norm(x, axis=1, keepdims=True))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, out = batch.column("vector").to_pylist(), []
            for v in vectors:
                x = np.array(v, dtype=float)
                turn = models.get(len(v))
                x = x / np.linalg.norm(x)
                out.append((x if turn is None else x @ turn).astype(np.float32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class", "label", "low", "copies", "vector")), pa.array([z.tolist() for z in out], pa.list_(pa.float32()))], ["class", "label", "low", "copies", "vector", "z"])

    label_kind, id_kind = (source.schema[c].dataType.simpleString() for c in ("label", "id"))
    grouped = valid.groupBy("label", "vector").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies")).withColumn("class", F.monotonically_increasing_id())
    classes = cut(grouped.select("class", "label", "low", "copies", "vector").mapInArrow(coded, f"class bigint, label {label_kind}, low {id_kind}, copies bigint, vector array<{element}>, z array<float>"))

    def tables(z: np.ndarray) -> list[np.ndarray]:
        return [np.arange(a, min(a + TABLE_BITS, z.shape[-1])) for a in range(0, z.shape[-1], TABLE_BITS)]

    def budget(n_tables: int) -> float:
        return (distance / n_tables + SLACK) / 4

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, table, code = [], [], []
            for k, values in enumerate(batch.column("z").to_pylist()):
                z = np.array(values, dtype=np.float32)
                parts = tables(z)
                found = [probes(z[p], budget(len(parts))) for p in parts]
                if any(f is None for f in found):
                    found, first = [[0]], WIDE
                else:
                    first = 0
                for t, codes in enumerate(found):
                    rows += [k] * len(codes)
                    table += [t + first] * len(codes)
                    code += codes
            taken = pa.array(rows, pa.int64())
            size = pa.array([len(v) for v in batch.column("z").to_pylist()], pa.int32()).take(taken)
            yield pa.RecordBatch.from_arrays([batch.column("class").take(taken), batch.column("label").take(taken), size, pa.array(table, pa.int32()), pa.array(code, pa.int64())], ["class", "label", "size", "table_no", "code"])

    keys = cut(classes.select("class", "label", "z").mapInArrow(keyed, f"class bigint, label {label_kind}, size int, table_no int, code bigint"))
    wide = keys.where(F.col("table_no") == WIDE).select("class", F.lit(True).alias("wide"))
    wide_labels = keys.where(F.col("table_no") == WIDE).select("label", "size").distinct()
    against = classes.select("class", "label", F.size("z").alias("size")).join(wide_labels, ["label", "size"]).select("class", "label", "size", F.lit(WIDE).alias("table_no"), F.lit(0).cast("bigint").alias("code"))
    group = ["label", "size", "table_no", "code"]
    met = with_blocks(keys.where(F.col("table_no") != WIDE).union(against), group, F.col("class"), BLOCK_ROWS)
    carried = met.join(classes.select("class", "copies", "vector", "z"), "class").join(wide, "class", "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    # One number tells the groups of a partition apart, whatever the label's type.
    carried = carried.withColumn("group_no", F.xxhash64(*group)).withColumn("label", F.col("label").cast("string"))
    by = ["group_no", "label", "size", "table_no", "code", "block_a", "block_b"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches, by):
            starts = group_starts(run, by)
            cell = {c: run.column(c).to_numpy() for c in ("class", "copies", "chunk", "wide", "table_no", "code", "block_a", "block_b")}
            flat = {c: run.column(c).combine_chunks() for c in ("vector", "z")}
            flat = {c: (np.asarray(v.flatten()), np.asarray(v.offsets) - v.offsets[0].as_py()) for c, v in flat.items()}
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), run.num_rows]):
                if b - a < 2:
                    continue
                x, z = (v[at[a] : at[b]].reshape(b - a, -1) for v, at in flat.values())
                x = x.astype(float)
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                near = np.triu(x @ x.T >= least, 1)
                if cell["block_a"][a] != cell["block_b"][a]:
                    chunk = cell["chunk"][a:b]
                    near &= chunk[:, None] != chunk[None, :]
                left, right = np.nonzero(near)
                if not len(left):
                    continue
                table, wide_row = int(cell["table_no"][a]), cell["wide"][a:b].astype(bool)
                stay = wide_row[left] | wide_row[right]
                if table != WIDE:
                    stay = ~stay
                    parts = tables(z)
                    for t in range(table + 1):
                        ok, common = shared(z[left][:, parts[t]], z[right][:, parts[t]], budget(len(parts)))
                        stay &= (ok & (common == cell["code"][a])) if t == table else ~ok
                left, right = left[stay], right[stay]
                if not len(left):
                    continue
                ids, copies = cell["class"][a:b], cell["copies"][a:b].astype(float)
                n = np.bincount(left, copies[right], len(ids)) + np.bincount(right, copies[left], len(ids))
                label = forest(len(ids), left, right)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[label[some]]), pa.array(n[some].astype(np.int64))], ["u", "v", "n"])

    placed = carried.repartition(*by).sortWithinPartitions(*by, "class")
    found = cut(placed.select(*by, "class", "chunk", "copies", "wide", "vector", "z").mapInArrow(compare, "u bigint, v bigint, n bigint"))
    links = found.groupBy("u").agg(F.sum("n").alias("n"))
    roots = components(found.select("u", "v"))
    info = classes.select("class", "label", "low", "copies", "vector").join(links, F.col("class") == F.col("u"), "left").join(roots, F.col("class") == F.col("node"), "left")
    info = info.select("class", "label", "vector", "low", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "class").alias("root"))
    lows = info.groupBy("root").agg(F.min("low").alias("component_id"))
    info = info.join(lows, "root").select("label", "vector", "n_links", "component_id")
    linked = valid.join(info, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = source.where(~F.coalesce(sound, F.lit(False))).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
