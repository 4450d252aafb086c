"""Secret scans: fixed patterns and character Markov models, in DataFrame functions only (operator 4)."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.quality import let

#: Kinds in the order that ties take: pattern, least length, and which group has it (fixed rules).
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]{16,}", 20, 0),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 24, 0),
)
#: Characters that the models know; strings of at least LEAST_LENGTH of them are compared.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_LENGTH = 20
#: Mean log-likelihood ratio a transition (in nats) from which a string counts as random.
THRESHOLD = 1.0
#: Documents whose words are the sample of ordinary strings, and generated random strings of each sort.
SAMPLE_DOCUMENTS, SAMPLE_RANDOM = 600, 1500
MASK = "[SECRET]"
#: Matches whose positions are summed up together.
CHUNK = 64


SPANS = "array<struct<start:int,end:int>>"


def located(text: Column, pattern: str, least: int, group: int) -> Column:
    """Array of struct(start, end) in code points: leftmost matches that do not overlap, short ones left out.

    Positions are running sums over the gaps and matches. They are summed up in chunks, so that a text with
    very many matches does not copy its list of spans for each of them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + x["gap"]
        end = begin + x["match"]
        return F.struct(end.alias("at"), F.concat(s["out"], F.when(x["size"] >= least, F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast(SPANS))).alias("out"))

    def spans(chunks: Column) -> Column:
        width = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x["gap"] + x["match"]))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(width, first, lambda s, w: F.struct((s["at"] + w).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        inner = F.zip_with(chunks, begins, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), F.array().cast(SPANS).alias("out")), step, lambda s: s["out"]))
        return F.flatten(inner)

    def places(own: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        rows = F.zip_with(F.slice(gaps, 1, F.size(own)), own, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m["match"]).alias("match"), F.length(m["size"]).alias("size")))
        chunks = lambda r: F.transform(F.sequence(F.lit(0), F.ceil(F.size(r) / CHUNK).cast("int") - 1), lambda k: F.slice(r, k * CHUNK + 1, F.lit(CHUNK)))
        return let(rows, lambda r: let(chunks(r), spans))

    both = F.zip_with(found, sized, lambda m, g: F.struct(m.alias("match"), g.alias("size")))
    return F.when(text.rlike(pattern), let(both, places)).otherwise(F.array().cast(SPANS))


def _pairs(samples: DataFrame) -> DataFrame:
    """Transition counts by label of rows (value, label)."""
    at = F.explode(F.sequence(F.lit(1), F.length("value") - 1))
    pair = samples.where(F.length("value") >= 2).select("label", "value", at.alias("i")).select("label", F.substring("value", F.col("i"), F.lit(2)).alias("pair"))
    return pair.groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n"))


def fit(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios (random against ordinary) of all transitions, from labelled rows (value, label).

    label 1 marks random strings, 0 ordinary ones. Spark counts the transitions; what reaches the driver is at
    most a row for each pair of known characters and label. Unseen transitions are smoothed by a half.
    """
    size = len(ALPHABET)
    counts = {label: [[0.5] * size for _ in range(size)] for label in (0, 1)}
    place = {c: k for k, c in enumerate(ALPHABET)}
    inside = F.col("pair").rlike(r"^[A-Za-z0-9+/_=\-]{2}$")
    for r in _pairs(samples).where(inside & F.col("label").isin(0, 1)).collect():
        counts[r["label"]][place[r["pair"][0]]][place[r["pair"][1]]] += r["n"]
    sums = {label: [sum(row) for row in table] for label, table in counts.items()}
    return [math.log(counts[1][a][b] / sums[1][a]) - math.log(counts[0][a][b] / sums[0][a]) for a in range(size) for b in range(size)]


def samples(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled rows: digests in hexadecimal and base64 are random; words, and identifiers made of two, are ordinary.

    The words are those of the SAMPLE_DOCUMENTS first documents in the order of a hash of their id; what the
    fixed patterns match there is left out of the ordinary words and joins the random ones.
    """
    ids = [r[0] for r in df.where(F.col(id_col).isNotNull()).select(F.col(id_col)).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_DOCUMENTS).collect()]
    digest = F.sha2(F.col("id").cast("string"), 256)
    random = spark.range(SAMPLE_RANDOM).select(F.explode(F.array(F.substring(digest, 1, 40), F.regexp_replace(F.base64(F.unhex(digest)), "=", ""), F.upper(F.substring(digest, 3, 20)), F.concat(F.lit("AKIA"), F.upper(F.regexp_replace(F.substring(F.base64(F.unhex(digest)), 1, 24), "[+/=]", ""))))).alias("value"), F.lit(1).alias("label"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sample = df.where(F.col(id_col).isin(ids)).select(text.alias("text"))
    clean = F.regexp_replace(F.regexp_replace(F.col("text"), BASE[0][1], " "), BASE[2][1], " ")
    words = sample.select(F.explode(F.regexp_extract_all(clean, F.lit(r"[A-Za-z0-9_]{2,}"), F.lit(0))).alias("value"))
    plain = words.select("value", F.lit(0).alias("label"))
    made = words.select(F.explode(F.array(F.concat(F.lower("value"), F.lit("_"), F.reverse(F.lower(F.substring("value", 1, 1))), F.lower("value")), F.concat(F.lower("value"), F.initcap(F.lower("value")), F.lit("2"), F.initcap(F.lower("value")), F.initcap(F.lower("value"))), F.concat(F.lower("value"), F.lit("-"), F.lower("value"), F.lit("/"), F.lower("value")), F.upper("value"))).alias("value"), F.lit(0).alias("label"))
    found = sample.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(BASE[2][1]), F.lit(0))).alias("value"), F.lit(1).alias("label"))
    return random.union(plain).union(made).union(found)


def ratio(value: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a string's transitions; the string has known characters only."""
    size = len(ALPHABET)
    scores = F.from_json(F.lit(json.dumps([round(x, 5) for x in table])), "array<double>")
    letters = F.lit(ALPHABET)
    code = lambda i: F.call_function("instr", letters, F.substring(value, i, F.lit(1)))
    step = lambda s, i: s + F.get(scores, (code(i) - 1) * size + code(i + 1) - 1)
    n = F.length(value) - 1
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), step) / n


def random_strings(text: Column, table: list[float], threshold: float = THRESHOLD) -> Column:
    """Spans of maximal strings of known characters that the models call random.

    A string needs a digit and a letter, since words of any language and plain numbers are ordinary.
    """
    pattern = rf"(?<![A-Za-z0-9+/_=\-])[A-Za-z0-9+/_=\-]{{{LEAST_LENGTH},}}"
    judged = F.transform(located(text, pattern, LEAST_LENGTH, 0), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("value")))
    kept = F.filter(judged, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (ratio(s["value"], table) >= threshold))
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def scan(df: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """(id, base, spans[, kept columns]) for every row: arrays of struct(start, kind_order, end, kind).

    base has the spans of the fixed patterns, spans these and the models' (kind random) that overlap none of
    them; both in order of start, then kind. Positions are code points, ends exclusive. Null and empty texts
    have empty arrays; repeated rows are scanned each.
    """
    text = F.col("secret_text")
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("secret_text"), *[F.col(c).alias(f"kept_{c}") for c in keep or []])
    named = lambda spans, k, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind_order"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    base = F.sort_array(F.concat(*[named(located(text, pattern, least, group), k, kind) for k, (kind, pattern, least, group) in enumerate(BASE)]))
    rows = rows.select("*", base.alias("base"), named(random_strings(text, table, threshold), len(BASE), "random").alias("extra"))
    free = F.filter("extra", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return rows.select(F.col(id_col), "base", F.sort_array(F.concat("base", free)).alias("spans"), "secret_text", *[F.col(f"kept_{c}").alias(c) for c in keep or []])


def written(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with each stretch of overlapping spans replaced by ``mask``; spans are in order of start.

    The pieces that stay are listed and joined once.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"])))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], fresh).otherwise(s["out"]).alias("out"))

    def woven(s: Column) -> Column:
        return F.array_join(F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, F.length(text)))), mask)

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, woven))
