"""Repair of conversations' structure with least edits, on an automaton of suffixes that all share (operator 12).

A conversation becomes a signature: one symbol a row for its role's initial and fault. Signatures are minimised from
the end: a node is a symbol and the node behind it, so equal suffixes are one node whichever conversations have them.
Each node holds, for each state of the grammar ``(s?(ua)+)?``, the least cost to the end and the first letter of the
best audit, whose rest is the next node's. Conversations of any length are cut into blocks of bounded size; the costs
behind a block come from a pass over the blocks' cost matrices, so all blocks are walked independently.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.functions.lineage import shared_folder
from statuta.llm.common import cut, nothing_kept_in_worker

#: Rows of a block at most: 2 to this power.
BLOCK_BITS = 12
#: Bytes of repaired text that are handed on at once for a conversation of several blocks.
PIECE_BYTES = 1 << 20
FILLED = r"[^\x20\x09-\x0D]"
#: Costs of the edits (fixed by the task).
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the grammar: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: Where an inserted or reroled row leads: an assistant after a user, else a user.
NEXT = (USER, USER, ASSISTANT, USER)
#: Costs behind the last row, where an open pair is closed by inserted rows.
END = (0, 2 * INSERT, INSERT, 0)
CLOSING = ("", "II", "I", "")
NEVER = 1 << 40


def _kept(symbol: str, state: int) -> int | None:
    if symbol == "s":
        return SYSTEM if state == START else None
    if symbol == "u":
        return USER if state != USER else None
    return ASSISTANT if symbol == "a" and state == USER else None


def _choices(symbol: str) -> list[list[tuple[int, str, int]]]:
    """(cost, letter, next state) of what may be done with a row in each state; X rows are only deleted."""
    found = []
    for state in STATES:
        options = [(DELETE, "D", state)]
        if symbol != "X":
            more = TRUNCATED if symbol.isupper() else 0
            to = _kept(symbol.lower(), state)
            options += [(KEEP + more, "K", to)] if to is not None else []
            options.append((REROLE + more, "R", NEXT[state]))
        found.append(options)
    return found


#: Symbols: a role's initial (o: any other), upper-case if the row is truncated; X for blank and repeated rows.
CHOICES = {s: _choices(s) for s in "suaoSUAOX"}


def node(symbol: str, behind: list[tuple]) -> list[tuple[int, str, int]]:
    """(least cost to the end, first letter, next state) in each state, from those of the node behind.

    Of equal costs the least letter is taken. Each letter leads to one state, so letter by letter this gives the
    audit that is least in ASCII.
    """
    own = [min((cost + behind[to][0], letter, to) for cost, letter, to in options) for options in CHOICES[symbol]]
    inserted = lambda state: (INSERT + own[NEXT[state]][0], "I", NEXT[state])
    user, assistant = min(own[USER], inserted(USER)), min(own[ASSISTANT], inserted(ASSISTANT))
    start, system = ((INSERT + user[0], "I", USER) for _ in range(2))
    return [min(own[START], start), min(own[SYSTEM], system), user, assistant]


class SuffixAutomaton:
    """The nodes of signatures that come sorted from their last symbol on.

    In that order equal suffixes follow each other, so each node is made once and only the path to the latest
    signature is held.
    """

    def __init__(self):
        self.key, self.path, self.reverse, self.made = None, [], "", 0

    def enter(self, reverse: str, key: tuple) -> None:
        """Go to a signature's node; key is (whether the conversation ends behind it, the four costs there)."""
        if key != self.key:
            self.key, self.path, self.reverse = key, [[(cost, "", state) for state, cost in enumerate(key[1:])]], ""
        shared = len(commonprefix([reverse, self.reverse])) if reverse != self.reverse else len(reverse)
        del self.path[shared + 1 :]
        for symbol in reverse[shared:]:
            self.path.append(node(symbol, self.path[-1]))
            self.made += 1
        self.reverse = reverse

    def costs(self) -> list[int]:
        return [entry[0] for entry in self.path[-1]]

    def audit(self, state: int) -> tuple[str, int]:
        """Letters of the best edits from a state on, and the state behind them."""
        letters, depth = [], len(self.path) - 1
        while depth:
            _, letter, state = self.path[depth][state]
            letters.append(letter)
            depth -= letter != "I"
        return "".join(letters) + (CLOSING[state] if self.key[0] else ""), state


def damage(rows: DataFrame) -> DataFrame:
    """The test's damage by crc32 of ``conv_id:turn`` modulo 20; nulls are one space, but a null turn stays null."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    held = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return held.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def _ordered(rows: DataFrame) -> DataFrame:
    """All rows in the order of conversation and turn as a written table, with their place (pos) in it.

    Ranges are cut anywhere, also within a conversation and between copies of a row, so no conversation, turn or row
    that a third of all rows share is one task. Rows of a turn come by the SHA-256 of role and text.
    """
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    key = ["conv_id", "turn", "digest", "any"]
    held = rows.withColumn("digest", digest).withColumn("any", F.monotonically_increasing_id())
    path = f"{shared_folder(rows.sparkSession)}/conversations-{uuid.uuid4().hex}"
    placed = held.repartitionByRange(*key).sortWithinPartitions(*key).drop("any").withColumn("pos", F.monotonically_increasing_id())
    placed.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(placed.schema).parquet(path).withColumn("block", F.shiftright("pos", BLOCK_BITS))


def _blocks(ordered: DataFrame) -> DataFrame:
    """(conv_id, block, signature, roles, counts of first faults) of each block of a conversation."""
    blank, initial = ~F.col("text").rlike(FILLED), F.substring("role", 1, 1)
    last = F.regexp_extract("text", rf"({FILLED})[\x20\x09-\x0D]*\z", 1)
    rows = ordered.select("conv_id", "block", "pos", "digest", blank.alias("blank"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("role"), (~last.isin(".", "!", "?")).alias("open"))
    firsts = rows.where("not blank").groupBy("conv_id", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(F.col("open"), "t").otherwise("-")
    judged = rows.join(firsts, "pos", "left").select("conv_id", "block", "pos", "role", fault.alias("fault"))
    symbol = F.when(F.col("fault").isin("b", "d"), "X").when(F.col("fault") == "t", F.upper("role")).otherwise(F.col("role"))
    held = judged.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("pos", symbol.alias("symbol"), "role"))).alias("rows"), *[F.count(F.when(F.col("fault") == k, 1)).alias(c) for k, c in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))]
    )
    joined = lambda field: F.array_join(F.transform("rows", lambda r: r[field]), "")
    return held.select("conv_id", "block", joined("symbol").alias("signature"), joined("role").alias("roles"), "blank", "duplicate", "truncated")


def _illegal(roles: Column) -> Column:
    """Neighbours in a string of initials that are no system-user, user-assistant or assistant-user pair."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(roles) - 1), lambda k: F.substring(roles, k, F.lit(2)))
    return F.when(F.length(roles) > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0).cast("bigint")


WALKED = "costs array<bigint>, audits array<string>, states array<int>"


def _walk(blocks: DataFrame) -> DataFrame:
    """Costs, audits and last states of each block from each state on, through the shared nodes.

    blocks has conv_id, block, signature, ends, behind (four costs) and entries (whether any state may enter it, or
    only the start). Equal signatures, however many, go through one node but may lie in several tasks.
    """
    key = ["ends", "behind", "reverse", "conv_id", "block"]
    rows = blocks.withColumn("reverse", F.reverse("signature")).select(*key, "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept_in_worker()
        automaton, latest, found = SuffixAutomaton(), None, None
        for batch in batches:
            out = []
            for ends, behind, reverse, entries in zip(*(batch.column(c).to_pylist() for c in ("ends", "behind", "reverse", "entries"))):
                if latest != (now := (ends, behind, reverse, entries)):
                    automaton.enter(reverse, (ends, *behind))
                    walks = [automaton.audit(s) for s in (STATES if entries else (START,))]
                    latest, found = now, (automaton.costs(), [w[0] for w in walks], [w[1] for w in walks])
                out.append(found)
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), batch.column("behind"), *columns], ["conv_id", "block", "behind", "costs", "audits", "states"])

    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, block bigint, behind array<bigint>, {WALKED}"
    return rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def _array(values) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def _behind(several: DataFrame) -> DataFrame:
    """Costs behind each block of conversations with several, and the part that all four have in common (base).

    Each block's matrix of least costs between states is found independently; then a task streams over a
    conversation's blocks from the last one on, holding four numbers.
    """
    units = F.array(*[F.struct(F.lit(k).alias("k"), _array(0 if s == k else NEVER for s in STATES).alias("behind")) for k in STATES])
    each = several.select("conv_id", "block", "signature", F.inline(units)).select("conv_id", "block", "signature", F.lit(False).alias("ends"), "behind", F.lit(False).alias("entries"))
    matrices = _walk(each).groupBy("conv_id", "block").agg(F.map_from_entries(F.collect_list(F.struct(F.array_position("behind", 0).alias("k"), "costs"))).alias("m"))
    rows = matrices.select("conv_id", "block", *[F.col("m")[F.lit(k + 1).cast("bigint")].alias(f"to{k}") for k in STATES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept_in_worker()
        latest, costs = object(), None
        for batch in batches:
            out = []
            for conv, *to in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "to0", "to1", "to2", "to3"))):
                if conv != latest:
                    latest, costs, ends = conv, list(END), True
                least = min(costs)
                out.append((ends, [c - least for c in costs], least))
                costs = [min(to[end][s] + costs[end] for end in STATES) for s in STATES]
                ends = False
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.bool_(), pa.list_(pa.int64()), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), *columns], ["conv_id", "block", "ends", "behind", "base"])

    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, block bigint, ends boolean, behind array<bigint>, base bigint"
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(run, schema)


def _entered(walked: DataFrame) -> DataFrame:
    """(conv_id, block, entry, audit, cost) of conversations with several blocks; cost is the first block's, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept_in_worker()
        latest, state = object(), START
        for batch in batches:
            out = []
            for conv, base, costs, audits, states in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "base", "costs", "audits", "states"))):
                first = conv != latest
                latest, state = conv, START if first else state
                out.append((state, audits[state], costs[START] + base if first else 0))
                state = states[state]
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), *columns], ["conv_id", "block", "entry", "audit", "cost"])

    schema = f"conv_id {walked.schema['conv_id'].dataType.simpleString()}, block bigint, entry int, audit string, cost bigint"
    return walked.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(run, schema)


class _Writer:
    """Messages of a block from its rows in order, its audit and the state at its beginning."""

    def __init__(self, audit: str, entry: int):
        self.audit, self.at, self.state, self.pieces, self.size = audit, 0, entry, [], 0

    def _add(self, message: str, state: int) -> None:
        held = b"\n" + message.encode()
        self.pieces.append(held)
        self.size += len(held)
        self.state = state

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._add("assistant:" if self.state == USER else "user:", NEXT[self.state])

    def row(self, role: str, text: str) -> None:
        self.inserted()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "K":
            self._add(f"{role}:{text}", _kept(role[:1], self.state))
        elif letter == "R":
            self._add(f"{'assistant' if self.state == USER else 'user'}:{text}", NEXT[self.state])

    def taken(self) -> bytes:
        out, self.pieces, self.size = b"".join(self.pieces), [], 0
        return out


def _written(ordered: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, block, piece, messages, sha256) of repaired texts, each message with a line break before it.

    A conversation of one block gives its hash at once, the others their messages in pieces of bounded size.
    """
    texts = ordered.select("conv_id", "block", "pos", "role", "text", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("int").alias("entry"), F.lit(None).cast("boolean").alias("alone"))
    heads = plan.select("conv_id", "block", F.lit(-1).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit", "entry", "alone")
    columns = ("conv_id", "block", "pos", "role", "text", "audit", "entry", "alone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept_in_worker()
        own, writer, out, size = None, None, [], 0

        def batch_of(rows):
            types = (conv_type, pa.int64(), pa.int64(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["conv_id", "block", "piece", "messages", "sha256"])

        def closed():
            writer.inserted()
            held = writer.taken()
            return (*own[:2], own[3], None, hashlib.sha256(held[1:]).hexdigest()) if own[2] else (*own[:2], own[3], held, None)

        for batch in batches:
            conv_type = batch.column("conv_id").type
            for conv, block, pos, role, text, audit, entry, alone in zip(*(batch.column(c).to_pylist() for c in columns)):
                if pos < 0:
                    if writer:
                        out.append(closed())
                    own, writer = [conv, block, alone, 0], _Writer(audit, entry)
                    continue
                writer.row(role, text)
                if not own[2] and writer.size >= PIECE_BYTES:
                    size += writer.size
                    out.append((*own[:2], own[3], writer.taken(), None))
                    own[3] += 1
                    if size >= PIECE_BYTES:
                        yield batch_of(out)
                        out, size = [], 0
            if out:
                yield batch_of(out)
                out, size = [], 0
        if writer:
            yield batch_of([closed()])

    schema = f"conv_id {ordered.schema['conv_id'].dataType.simpleString()}, block bigint, piece bigint, messages binary, sha256 string"
    return texts.unionByName(heads).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos").mapInArrow(run, schema)


def _hashed(pieces: DataFrame) -> DataFrame:
    """(conv_id, audit, sha256) of conversations with several blocks, whose pieces stream by in order."""
    conv = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept_in_worker()
        latest, digest, started, audits, conv_type = object(), None, False, [], None

        def closed():
            return pa.RecordBatch.from_arrays([pa.array([latest], conv_type), pa.array(["".join(audits)]), pa.array([digest.hexdigest()])], ["conv_id", "audit", "sha256"])

        for batch in batches:
            conv_type = batch.column("conv_id").type
            for k, now in enumerate(batch.column("conv_id").to_pylist()):
                if digest is None or now != latest:
                    if digest is not None:
                        yield closed()
                    latest, digest, started, audits = now, hashlib.sha256(), False, []
                audit, messages = batch.column("audit")[k].as_py(), batch.column("messages")[k].as_py()
                audits += [audit] if audit else []
                if messages:
                    digest.update(messages if started else messages[1:])
                    started = True
        if digest is not None:
            yield closed()

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "block", "piece").mapInArrow(run, f"conv_id {conv}, audit string, sha256 string")


def repair(rows: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Faults, cheapest edits and the repaired text's hash of each conversation in (conv_id, turn, role, text).

    One row for each conv_id, a null one included, and for each in ``named``: zeros, an empty audit and the hash of
    nothing for those without rows. Rows come by turn, those without one first; rows of one turn by the
    SHA-256 of role and text. Null roles and texts are one space. A role counts by its initial, any but s, u and a
    (and an empty role) can only be reroled or deleted. Blank rows and those whose role and text came before are
    deleted. Repeated rows are duplicates; a very long text is one row; other columns are not read. An empty table
    gives an empty one.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    ordered = _ordered(rows.select("conv_id", "turn", blank("role"), blank("text")))
    order = Window.partitionBy("conv_id").orderBy("block")
    found = _blocks(ordered)
    blocks = cut(found.withColumn("before", F.lag(F.substring("roles", -1, 1)).over(order)).withColumn("alone", F.col("before").isNull() & F.lead("block").over(order).isNull()))
    single = blocks.where("alone").select("conv_id", "block", "signature", F.lit(True).alias("ends"), _array(END).alias("behind"), F.lit(False).alias("entries"))
    several = blocks.where("not alone").select("conv_id", "block", "signature")
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["block"] == b["block"])
    behind = cut(_behind(several))
    held = several.join(behind, same(several, behind)).select(several["*"], "ends", behind["behind"], F.lit(True).alias("entries"))
    walked = cut(_walk(single.union(held.select(*single.columns))))
    alone = walked.where(F.size("states") == 1).select("conv_id", "block", F.lit(START).alias("entry"), F.col("audits")[0].alias("audit"), F.col("costs")[START].alias("cost"), F.lit(True).alias("alone"))
    others = walked.where(F.size("states") > 1)
    entered = _entered(others.join(behind, same(others, behind)).select(others["conv_id"], others["block"], "base", "costs", "audits", "states"))
    plan = cut(alone.union(entered.select("*", F.lit(False).alias("alone"))))
    written = cut(_written(ordered, plan))
    many = plan.where("not alone")
    # The audit goes with a block's first piece.
    pieces = written.where("sha256 is null").join(many.withColumnRenamed("conv_id", "c").select("c", F.col("block").alias("b"), "audit"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    hashed = _hashed(pieces.select("conv_id", "block", "piece", F.when(F.col("piece") == 0, F.col("audit")).alias("audit"), "messages"))
    return _report(rows if named is None else named, ordered, blocks, plan, written, hashed)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _report(named: DataFrame, ordered: DataFrame, blocks: DataFrame, plan: DataFrame, written: DataFrame, hashed: DataFrame) -> DataFrame:
    turns = ordered.select("conv_id", "turn").where("turn is not null").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("bigint").alias("gaps"))
    # A row of the block before a block's own first one makes the pair across them.
    illegal = _illegal(F.concat(F.coalesce("before", F.lit("")), "roles"))
    parts = [
        named.select("conv_id"),
        turns,
        blocks.select("conv_id", "blank", "duplicate", "truncated", illegal.alias("illegal")),
        plan.select("conv_id", "cost", F.when(F.col("alone"), F.col("audit")).alias("audit")),
        written.where("sha256 is not null").select("conv_id", "sha256"),
        hashed.select("conv_id", "audit", "sha256"),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS]
    empty = hashlib.sha256(b"").hexdigest()
    return every.groupBy("conv_id").agg(*sums, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha256"), F.lit(empty)).alias("repaired_sha256"))
