"""Operators 11 to 13 against brute force and held-out labels, on tables with odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
llm = pytest.importorskip("statuta.llm.queries")
from statuta.llm import conversations, filter_audit, ranking  # noqa: E402
from statuta.llm.common import crc_fold  # noqa: E402

WORD = r"[^\x20\x09-\x0D]+"
SF = "/root/testdata/sf0.01"


def collected(df):
    return [r.asDict() for r in df.collect()]


# --- operator 11


def test_bradley_terry_recovers_an_order():
    rng = np.random.default_rng(1)
    true = np.array([2.0, -1.0, 0.0, 0.5])
    a, b = rng.normal(size=(4000, 4)), rng.normal(size=(4000, 4))
    wins = rng.random(4000) < 1 / (1 + np.exp(-(a - b) @ true))
    found = ranking.bradley_terry(np.where(wins[:, None], a, b), np.where(wins[:, None], b, a), ridge=0.0)
    assert np.abs(found - true).max() < 0.15
    better, worse = ranking.preferences(np.array([1, 1, 0, 1, 0]))
    assert set(better.tolist()) == {0, 1, 3} and sorted(zip(better.tolist(), worse.tolist())) == sorted((a, b) for a in (0, 1, 3) for b in (2, 4))


def test_ranking_on_held_out_rows(spark):
    docs, labels = ranking.describe(spark.read.parquet(f"{SF}/documents.parquet")), spark.read.parquet(f"{SF}/labels.parquet")
    fold = crc_fold(F.col("doc_id"), 4)
    model = ranking.fit(docs, labels, fold != 2)
    found = collected(ranking.score(docs, model).join(labels, "doc_id").where(fold == 2))
    right = [r["predicted"] == r["quality"] for r in found]
    assert len(found) > 60 and np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)


def test_ranking_of_odd_rows(spark):
    long = "word number after word, and so on. " * 60_000
    rows = [(1, "good text of some words, and more of them.", "x", "y", "z"), (2, "bad ### $$$ %%% *** ###", "x", "y", "z"), (3, None, None, None, None), (4, "", "x", "y", "z"), (4, "", "x", "y", "z"), (None, "good words, in a row.", "x", "y", "z"), (5, long, "x", "y", "z")]
    docs = ranking.describe(spark.createDataFrame(rows, "doc_id long, text string, id string, y string, score string"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (5, None), (5, 1), (4, 7)], "doc_id long, quality int")
    model = ranking.fit(docs, labels, F.lit(True))
    found = collected(ranking.score(docs, model))
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows)
    by_id = {r["doc_id"]: r["predicted"] for r in found}
    assert by_id[1] == 1 and by_id[2] == 0 and by_id[3] == by_id[4] == 0 and by_id[5] == 1
    one_kind = ranking.fit(docs, labels.where("quality = 1"), F.lit(True))
    assert {r["score"] for r in collected(ranking.score(docs, one_kind))} == {2.5 / 3}
    nothing = ranking.fit(docs.limit(0), labels, F.lit(True))
    assert ranking.score(docs.limit(0), nothing).count() == 0 and {r["score"] for r in collected(ranking.score(docs, nothing))} == {0.5}


def test_features_are_bounded():
    texts = pa.array(["", "a" * 200_000, "é! " * 9, "\n\n\n", "a\nb\na\n" * 40], pa.large_string())
    found = ranking.features(texts)
    assert found.shape == (5, len(ranking.FEATURES)) and np.isfinite(found).all() and np.abs(found).max() <= 8
    assert np.array_equal(ranking.features(texts[2:3])[0], found[2])


# --- operator 12


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out += [row, row] if kind == 3 else [row]
    return out


def cheapest(symbols):
    """Least cost, then ASCII-least audit, by Dijkstra's algorithm over (row, role state)."""
    accepts, heap, seen = {0: "su", 1: "u", 2: "a", 3: "u"}, [(0, "", 0, 0)], set()
    to = {"s": 1, "u": 2, "a": 3}
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(symbols) and state in (0, 3):
            return cost, audit
        if (at, state) in seen:
            continue
        seen.add((at, state))
        steps = [(5, "I", at, to[r]) for r in "ua" if r in accepts[state]]
        if at < len(symbols):
            role, fault = symbols[at]
            steps.append((2, "D", at + 1, state))
            if fault not in "bd":
                more = 5 * (fault == "t")
                steps += [(more, "K", at + 1, to[role])] if role and role in accepts[state] else []
                steps += [(1 + more, "R", at + 1, to[r]) for r in "ua" if r in accepts[state]]
        for c, letter, i, s in steps:
            heapq.heappush(heap, (cost + c, audit + letter, i, s))


def brute_repair(rows):
    found = {}
    held = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in held if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        seen, symbols, faults = set(), [], []
        for _, _, role, text in own:
            filled = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "b" if not filled else "d" if (role, text) in seen else "t" if filled[-1] not in ".!?" else "-"
            seen.add((role, text))
            symbols.append((role[:1], fault))
            faults.append(fault)
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit = cheapest(symbols)
        out, at, state = [], 0, 0
        for letter in audit:
            needed = "assistant" if state == 2 else "user"
            if letter == "I":
                out.append(f"{needed}:")
            else:
                role, text = own[at][2:]
                at += 1
                if letter == "D":
                    continue
                needed = role if letter == "K" else needed
                out.append(f"{needed}:{text}")
            state = {"s": 1, "u": 2, "a": 3}[needed[0]]
        pairs = [a[0] + b[0] for a, b in zip(symbols, symbols[1:])]
        found[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return found


@pytest.mark.parametrize("bits", [conversations.BLOCK_BITS, 2])
def test_repair_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "BLOCK_BITS", bits)
    monkeypatch.setattr(conversations, "PIECE_BYTES", 40)
    rng = random.Random(bits)
    texts = ["Yes.", "No!", "open end", "", " \n", "What?", "x" * 50 + ".", "Fine. \t", "é ", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "usr", "Süß"]
    rows = []
    for conv in range(60):
        rows += [(conv, t + rng.randrange(2), rng.choice(roles[: rng.choice((4, 10))]), rng.choice(texts)) for t in range(rng.randrange(1, 9))]
    rows += [(900, t, ("user", "assistant")[t % 2] if rng.random() < 0.8 else rng.choice(roles), f"{rng.choice(texts)}{rng.randrange(30)}.") for t in range(70)]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (901, None, "user", "a."), (901, None, "user", "a."), (901, None, "assistant", None)] + [(902, 5, "user", "same.")] * 30
    rows += [(903, 0, "user", "long. " * 200_000), (903, 1, "assistant", "Yes.")]
    rows += [(1000 + k, 0, "user", "gone?") for k in range(40)]  # some lose their only row
    table = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, digest string, pos int, block int").repartition(3)
    found = {r["conv_id"]: r for r in collected(conversations.repair(conversations.damage(table), table))}
    want = brute_repair(rows)
    assert set(found) == set(want)
    for conv, expected in want.items():
        r = found[conv]
        assert tuple(r[c] for c in (*conversations.COUNTS, "audit", "repaired_sha256")) == expected, conv
    assert any(w[6] == "" and w[7] == hashlib.sha256(b"").hexdigest() for c, w in want.items() if (c or 0) >= 1000)


def test_repair_of_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damage(none), none).count() == 0


def test_equal_suffixes_are_one_node():
    signatures = ["uaua", "suaua", "aua", "XaXua", "uOua", "ua", "ua"]
    automaton = conversations.SuffixAutomaton()
    for reverse in sorted(s[::-1] for s in signatures):
        automaton.enter(reverse, (True, *conversations.END))
    assert automaton.made == len({s[k:] for s in signatures for k in range(len(s))})


# --- operator 13


def brute_audit(docs, labels):
    first, good, toxic = {}, {}, {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    for d, q, t in labels:
        good[d], toxic[d] = good.get(d) or q == 1, toxic.get(d) or t == 1
    rows = []
    for d, text, lang in docs:
        text = text or ""
        w = re.findall(WORD, text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and first[text] < d}
        rows.append((lang or "", {k for k, v in fails.items() if v}, bool(d is not None and good.get(d)), bool(d is not None and toxic.get(d))))
    out = {}
    for part in {r[0] for r in rows}:
        own, total = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                out[part, order, k + 1] = [len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(total[order[k - 1]])
    return out


def test_audit_against_brute_force(spark):
    rng = random.Random(3)
    pool = ["the", "of", "And", "WORD", "x", "né", "tail", "#tag", "50%", "a|b", *(f"w{k}" for k in range(300))]
    texts = [" ".join(rng.choice(pool[: rng.choice((6, 40, 310))]) for _ in range(rng.choice((3, 199, 200, 260)))) for _ in range(40)]
    texts += [None, "", " \n ", "A", "É" * 30, "😀A " * 40, "word " * 250_000, "a b " * 50]
    docs = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(150)]
    docs += docs[:5] + [(None, texts[0], "en"), (None, None, None), (0, texts[1], "de")] + [(500 + k, texts[2], "fr") for k in range(20)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 160, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame([(*d, 1, "m", "p") for d in docs], "doc_id long, text string, lang string, n int, mask string, part string").repartition(3)
    said = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in collected(filter_audit.audit(table, said))}
    assert found == brute_audit(docs, labels)
    assert filter_audit.audit(table.limit(0), said).count() == 0


def test_removal_ranks():
    orders, places, ranks = filter_audit.removal_ranks(3)
    for o, order in enumerate(orders):
        assert [order[p - 1] for p in places[o]] == [0, 1, 2]
        for mask in range(8):
            assert ranks[mask, o] == next((k + 1 for k, f in enumerate(order) if mask >> f & 1), 4)
