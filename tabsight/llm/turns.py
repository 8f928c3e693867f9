"""Conversation structure repair by the auction algorithm for shortest paths.

**Lattice.** A conversation's rows in order and the four states of the wanted form ``(system? (user assistant)+)?`` (nothing
yet, after system, after user, after assistant) span a lattice. From (row, state) go: Delete the row (cost 4), Keep it if its
role may follow (0), Rerole it to the role that must follow (3), Insert that role with an empty text before it (3). Blank and
duplicate rows can only be deleted; a truncated row that stays costs 3 more. After the last row the open form is closed by
inserts. A letter (D, I, K, R) names one edge of a node, so an audit string names one path.

**Auction.** Every node has a price, at most any edge's cost plus the price at its end; at first what the rows from there on cost
in any case. A path grows from the origin: if the price of its last node is below the best cost plus price of its edges, the
price rises to that and the path contracts by the node; else it extends along the best edge. When it reaches the sink the
price of the origin is the shortest distance (Bertsekas 1991). Then every edge of every shortest path is tight, its cost
equals the difference of its prices, and the walk that takes the least letter among tight edges, backing out of nodes whose
tight edges end nowhere, is the least audit string of least cost.

**Spark's part.** One range shuffle by (conversation, turn, role, text) puts rows in order; tasks stream through their slices and
solve every conversation that lies inside a slice. Those cut by a slice's edge or longer than ``CHUNK_ROWS`` go on as chunks,
whatever their length: duplicates are found by grouped minima over text hashes, each chunk's cheapest costs between states
are combined from the last chunk to the first (a row of 16 numbers a chunk), those are the prices at the chunk's far edge, and
each chunk traces its own tight edges. The hash of the repaired text reads the chunks in order, one conversation a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tabsight.llm.common import deleted, staged

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
BLANKS = b" \t\n\v\f\r"
#: Rows, and bytes of text, of a chunk.
CHUNK_ROWS, CHUNK_BYTES = 128, 4 << 20
#: States of the form; what must come next by user or assistant; where a kept system row leads.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: b"user", ASSISTANT: b"assistant"}
KEEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Letters that close the form from each state, and what they cost.
CLOSING = ("", "II", "I", "")
CLOSE = tuple(INSERT * len(x) for x in CLOSING)
LEGAL = {"su", "ua", "au"}


# --- the lattice and the auction ----------------------------------------------------------------------------------------------
# A conversation is coded as one letter a row: the role's initial (s, u, a, or x for any other), as a capital if the row is
# truncated, and - for a row that has to go.


def lattice(codes: str, exits: tuple, states: tuple = (0, 1, 2, 3)) -> tuple[list[list], list[int], int]:
    """Edges (letter, cost, end) of node 4 * row + state, first prices, and the sink, reached from ``states`` after the last
    row at the costs ``exits``."""
    n = len(codes)
    sink = 4 * n + 4
    edges: list[list] = [[] for _ in range(sink + 1)]
    prices = [0] * (sink + 1)
    for i in range(n - 1, -1, -1):
        code = codes[i]
        extra = TRUNCATED if code.isupper() else 0
        least = DELETE if code == "-" else extra
        for s in states:
            at = 4 * i + s
            prices[at] = prices[4 * i + 4 + s] + least
            edges[at].append(("D", DELETE, at + 4))
            if NEXT[s] in states:
                edges[at].append(("I", INSERT, 4 * i + NEXT[s]))
            if code != "-":
                kept = KEEPS.get((s, code.lower()))
                if kept in states:
                    edges[at].append(("K", extra, 4 * i + 4 + kept))
                if NEXT[s] in states:
                    edges[at].append(("R", REROLE + extra, 4 * i + 4 + NEXT[s]))
    for s in states:
        if exits[s] is not None:
            edges[4 * n + s].append(("", exits[s], sink))
    return edges, prices, sink


def auction(edges: list[list], prices: list[int], origin: int, sink: int) -> int:
    """Raise ``prices`` until the path from ``origin`` reaches ``sink``; the distance."""
    path = [origin]
    while (at := path[-1]) != sink:
        best, end = None, -1
        for _, cost, head in edges[at]:
            if best is None or cost + prices[head] < best:
                best, end = cost + prices[head], head
        if best is None:  # nothing leads on
            best = 1 << 60
        if prices[at] < best:
            prices[at] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(end)
    return prices[origin] - prices[sink]


def traced(edges: list[list], prices: list[int], origin: int, sink: int) -> tuple[str, int]:
    """The least letters along tight edges, and the last node before the sink."""
    path, letters, dead = [origin], [], set()
    while (at := path[-1]) != sink:
        for letter, cost, head in edges[at]:  # in the order of their letters
            if prices[at] == cost + prices[head] and head not in dead:
                path.append(head)
                letters.append(letter)
                break
        else:
            dead.add(at)
            path.pop()
            letters.pop()
    return "".join(letters), path[-2]


def solved(codes: str, exits: tuple, origins: tuple = (0, 1, 2, 3)) -> list[tuple[int, str, int] | None]:
    """For each entry state of ``origins``: cost, letters and exit state; prices carry over from one origin to the next."""
    edges, prices, sink = lattice(codes, exits)
    out: list = [None] * 4
    for s in origins:
        cost = auction(edges, prices, s, sink)
        letters, last = traced(edges, prices, s, sink)
        out[s] = cost, letters, last - 4 * len(codes)
    return out


@lru_cache(1 << 16)
def repaired(codes: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation; equal codes are solved once a task."""
    cost, letters, state = solved(codes, CLOSE, (NOTHING,))[NOTHING]
    return cost, letters + CLOSING[state]


@lru_cache(1 << 12)
def crossings(codes: str) -> list[int]:
    """Cheapest costs of a chunk from each entry state to each exit state, row by row; -1 where there is no way."""
    out = [-1] * 16
    for state in range(4):
        states = tuple(range(state + 1)) if state < USER else (0, 1, 2, 3)
        exits = tuple(0 if s == state else None for s in range(4))
        edges, prices, sink = lattice(codes, exits, states)
        for s in states:
            # The beginnings of the form are never entered again, and only a kept system row leads to the second.
            if state == SYSTEM and s == NOTHING and not set(codes) & set("sS"):
                continue
            out[4 * s + state] = auction(edges, prices, s, sink)
    return out


# --- rows ---------------------------------------------------------------------------------------------------------------------


def initial(role: bytes) -> str:
    return chr(role[0]) if role[:1] in (b"s", b"u", b"a") else "x"


def code(role: bytes, text: bytes, seen: set) -> tuple[str, str]:
    """A row's code and its first fault (b, d, t or none); ``seen`` gets the hash of role and text."""
    mark = xxhash.xxh3_128_digest(b"%d:%b%b" % (len(role), role, text))
    again = mark in seen
    seen.add(mark)
    body = text.strip(BLANKS)
    if not body:
        return "-", "b"
    if again:
        return "-", "d"
    return (initial(role), "") if body[-1:] in b".!?" else (initial(role).upper(), "t")


def lines(audit: str, rows: list[tuple[bytes, bytes]], state: int) -> tuple[list[bytes], int]:
    """``role:text`` of what the edits leave of ``rows``, and the state after them."""
    out, at = [], iter(rows)
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            out.append(ROLE[state] + b":")
            continue
        role, text = next(at)
        if letter == "K":
            state = KEEPS[state, initial(role)]
            out.append(role + b":" + text)
        elif letter == "R":
            state = NEXT[state]
            out.append(ROLE[state] + b":" + text)
    return out, state


def illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
#: A part of a conversation: place, rows, and what its neighbours need to know of it.
CHUNK = "slice long, seq long, codes string, faults string, initials string, turns array<long>, marks array<binary>, roles array<binary>, texts array<binary>"


def whole(rows: list[tuple]) -> tuple:
    """The result of a conversation in one piece; rows are (turn, role, text) in order."""
    if not rows:
        return EMPTY
    seen: set = set()
    coded = [code(role, text, seen) for _, role, text in rows]
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults = "".join(f for _, f in coded)
    cost, audit = repaired("".join(c for c, _ in coded))
    kept, _ = lines(audit, [(role, text) for _, role, text in rows], NOTHING)
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal("".join(initial(r) for _, r, _ in rows)), cost, audit, hashlib.sha256(b"\n".join(kept)).hexdigest()


def chunk(number: int, seq: int, rows: list[tuple]) -> tuple:
    """A part of a conversation; duplicates of other parts are not known yet."""
    seen: set = set()
    coded = [code(role, text, seen) for _, role, text in rows]
    turns = [t for t, _, _ in rows if t is not None]
    span = [turns[0], turns[-1], len(set(turns))] if turns else []
    marks = [xxhash.xxh3_128_digest(b"%d:%b%b" % (len(role), role, text)) for _, role, text in rows]
    faults = "".join(f or "-" for _, f in coded)
    return number, seq, "".join(c for c, _ in coded), faults, "".join(initial(r) for _, r, _ in rows), span, marks, [r for _, r, _ in rows], [t for _, _, t in rows]


RESULT_NAMES, CHUNK_NAMES = ([c.split()[0] for c in x.split(", ")] for x in (RESULT, CHUNK))
RESULT_TYPES = [pa.int64()] * len(COUNTS) + [pa.string(), pa.string()]
_BYTES = pa.list_(pa.binary())
CHUNK_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), _BYTES, _BYTES, _BYTES]


def _along(most_rows: int, most_bytes: int):
    """mapInArrow over rows in order: a result for every conversation that surely is in one piece, else its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        kind = None
        current, rows, size, seq, first = object(), [], 0, 0, True
        done: list[tuple] = []

        def flush(cut: bool) -> None:
            """Hand on what is held; ``cut``: more of this conversation may follow, or may have been before."""
            nonlocal rows, size, seq
            if cut or first or seq:
                done.append((current, *[None] * len(RESULT_NAMES), *chunk(number, seq, rows)))
            else:
                done.append((current, *whole(rows), *[None] * len(CHUNK_NAMES)))
            rows, size, seq = [], 0, seq + 1

        def out() -> pa.RecordBatch:
            types = [kind, *RESULT_TYPES, *CHUNK_TYPES]
            columns = [pa.array([d[i] for d in done], t) for i, t in enumerate(types)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *RESULT_NAMES, *CHUNK_NAMES])

        started = False
        for batch in batches:
            kind = batch.column("conv_id").type
            columns = [batch.column("conv_id").to_pylist(), batch.column("dropped").to_pylist(), batch.column("turn").to_pylist()]
            columns += [batch.column(c).cast(pa.binary()).to_pylist() for c in ("role", "text")]
            for conv, dropped, turn, role, text in zip(*columns):
                if not started or conv != current:
                    if started:
                        flush(False)
                        first = False
                    current, rows, size, seq, started = conv, [], 0, 0, True
                if not dropped:
                    rows.append((turn, role, text))
                    size += len(text)
                    if len(rows) >= most_rows or size >= most_bytes:
                        flush(True)
                if len(done) >= 1024:
                    yield out()
        if started:
            flush(True)
        if done:
            yield out()

    return run


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage of (conv_id, turn, role, text): a row that is dropped stays with ``dropped`` set, so that its
    conversation is not lost. Null roles and texts become one space, so do nulls in the hashed name of the row."""
    blank = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    hit = F.crc32(F.encode(name, "UTF-8")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    changed = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (hit == 0).alias("dropped"),
        F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return changed.drop("copy")


def structure(rows: DataFrame, partitions: int | None = None, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row a conversation of ``rows`` (conv_id, turn long, role, text, dropped boolean): conv_id and the columns of ``RESULT``.

    Rows of a conversation are taken by turn, nulls first, equal turns by role and text. Null conv_ids are one conversation.
    A conversation whose rows are all dropped has zeros, an empty audit and the hash of nothing. An empty table gives an empty
    result; other columns are not read.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    own = [F.col("conv_id"), F.col("turn"), F.col("role")]
    keys = [*own, F.substring("text", 1, 32)]
    narrow = rows.select("conv_id", "turn", "role", "text", "dropped")
    ranged = narrow.repartitionByRange(partitions, *keys) if partitions else narrow.repartitionByRange(*keys)
    ordered = ranged.sortWithinPartitions(*own, "text")
    found = staged(ordered.mapInArrow(_along(chunk_rows, chunk_bytes), f"conv_id {kind}, {RESULT}, {CHUNK}"), "conversations")
    joined = assembled(chunks_of(found), kind)
    return found.where("slice is null").select("conv_id", *RESULT_NAMES).unionAll(joined)


# --- conversations in several chunks ------------------------------------------------------------------------------------------

PLACE = ["conv", "slice", "seq"]


def named(conv: str) -> Column:
    """A conversation's name that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))


def chunks_of(found: DataFrame) -> DataFrame:
    """The chunks with the rows that an earlier chunk already has: (conv, slice, seq, ..., codes and faults set right).

    Rows that are repeated inside a chunk are known, so a text counts once a chunk.
    """
    parts = found.where("slice is not null").withColumn("conv", named("conv_id"))
    marks = parts.select(*PLACE, "faults", F.posexplode("marks").alias("i", "mark"))
    firsts = marks.groupBy(*PLACE, "mark").agg(F.min("i").alias("i"), F.min_by(F.substring("faults", F.col("i") + 1, F.lit(1)), "i").alias("fault"))
    held = staged(firsts, "marks")
    shared = held.groupBy("conv", "mark").agg(F.min(F.struct("slice", "seq")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = held.where("fault <> 'b'").join(shared, ["conv", "mark"]).where(F.struct("slice", "seq") != F.col("first"))
    places = again.groupBy(*PLACE).agg(F.collect_set("i").alias("again"))  # one chunk's rows at most
    gone = lambda column, letter: F.array_join(
        F.transform(F.split(column, ""), lambda c, i: F.when(F.array_contains("again", i), letter).otherwise(c)), ""
    )
    return parts.join(places, PLACE, "left").withColumns(
        {c: F.when(F.col("again").isNull(), F.col(c)).otherwise(gone(c, letter)) for c, letter in (("codes", "-"), ("faults", "d"))}
    )


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cost = pa.array([crossings(c) for c in batch.column("codes").to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in PLACE], cost], [*PLACE, "cost"])


def _edge_prices(table: pa.Table) -> pa.Table:
    """From the last chunk of a conversation to the first: the prices of the four states at each chunk's far edge."""
    table = table.sort_by([("slice", "ascending"), ("seq", "ascending")])
    far, out = list(CLOSE), []
    for cost in reversed(table.column("cost").to_pylist()):
        out.append(far)
        far = [min(cost[4 * s + x] + far[x] for x in range(4) if cost[4 * s + x] >= 0) for s in range(4)]
    return table.drop(["cost"]).append_column("far", pa.array(out[::-1], pa.list_(pa.int64())))


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters, cost and exit state of each chunk from each entry state, under the prices at its far edge."""
    for batch in batches:
        found = [solved(c, tuple(far)) for c, far in zip(batch.column("codes").to_pylist(), batch.column("far").to_pylist())]
        columns = [pa.array([[x[i] for x in f] for f in found], pa.list_(t)) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in PLACE], *columns], [*PLACE, "costs", "audits", "leave"])


class _Joined:
    """A conversation as its chunks go by in order: counts, letters and the running hash."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.audit = conv, NOTHING, None, []
        self.faults, self.illegal, self.before = {"b": 0, "d": 0, "t": 0}, 0, ""
        self.low = self.high = None
        self.turns, self.hash, self.lines = 0, hashlib.sha256(), 0

    def write(self, lines_: list[bytes]) -> None:
        for line in lines_:
            self.hash.update(b"\n" + line if self.lines else line)
            self.lines += 1

    def add(self, r: dict) -> None:
        if not r["codes"]:
            return
        for f in self.faults:
            self.faults[f] += r["faults"].count(f)
        self.illegal += illegal(self.before[-1:] + r["initials"])
        self.before = r["initials"]
        if r["turns"]:
            low, high, n = r["turns"]
            self.turns += n - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high
        if self.cost is None:  # the first chunk's price is the whole conversation's
            self.cost = r["costs"][self.state]
        letters = r["audits"][self.state]
        kept, after = lines(letters, list(zip(r["roles"], r["texts"])), self.state)
        self.write(kept)
        self.audit.append(letters)
        self.state = after

    def result(self) -> tuple:
        if self.cost is None:
            return self.conv, *EMPTY
        self.audit.append(CLOSING[self.state])
        self.write(lines(CLOSING[self.state], [], self.state)[0])
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, name, done, kind = None, None, [], None

    def out() -> pa.RecordBatch:
        columns = [pa.array([d[i] for d in done], t) for i, t in enumerate([kind, *RESULT_TYPES])]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *RESULT_NAMES])

    for batch in batches:
        kind = batch.column("conv_id").type
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if held is None or r["conv"] != name:
                if held:
                    done.append(held.result())
                held, name = _Joined(r["conv_id"]), r["conv"]
            held.add(r)
        if len(done) >= 1024:
            yield out()
    if held:
        done.append(held.result())
    if done:
        yield out()


def assembled(chunks: DataFrame, kind: str) -> DataFrame:
    """The results of the conversations that came in chunks."""
    chunks = staged(chunks.drop("marks", "again", *RESULT_NAMES), "chunks")
    place = ", ".join(f"{c} {t}" for c, t in zip(PLACE, ("string", "long", "long")))
    coded = chunks.where("codes <> ''").select(*PLACE, "codes")
    far = coded.mapInArrow(_costs, f"{place}, cost array<long>").groupBy("conv").applyInArrow(_edge_prices, f"{place}, far array<long>")
    traces = coded.join(far, PLACE).mapInArrow(_traces, f"{place}, costs array<long>, audits array<string>, leave array<long>")
    ordered = chunks.join(traces, PLACE, "left").repartition("conv").sortWithinPartitions(*PLACE)
    return ordered.mapInArrow(_in_order, f"conv_id {kind}, {RESULT}")


def repair(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """The query's rows: :func:`structure` of the :func:`damaged` conversations."""
    return structure(damaged(rows), partitions)
