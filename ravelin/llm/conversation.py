"""Conversation structure repair by block tables (the Four-Russians method).

Rows of a conversation become symbols: the initial of the role, whether the text breaks off, or a row that must go. The
least cost of repairing what follows is a vector over the four states of the role grammar `(s?(ua)+)?`. Less their
minimum, such vectors are few (VECTORS), so the step over every block of BLOCK symbols is worked out once, for every
vector, and conversations are gone through from the end by one lookup per block. Tracing goes forwards and expands one
block at a time backwards, so that among the cheapest edits the ASCII-least are taken.

Rows are dealt by ranges of (conv_id, turn, ...), which splits a conversation however large it is. A conversation that
lies inside one range is repaired there. One that is cut by a range's end, or that is longer than a chunk, is kept as
chunks of bounded size; each chunk's step is worked out for every vector, the steps are composed backwards and the
states forwards, and chunks are repaired side by side. Only the hash of a whole conversation runs through it in order,
holding one chunk at a time.

Defined results: a null text or role is one space, and so is a null conv_id or turn where rows are dealt their damage;
rows without conv_id are one conversation; rows of one turn are ordered by role, by crc32 of the text, then as they come;
repeated rows are duplicates; a conversation that lost all rows has zeros, an empty audit and the hash of an empty string;
very long texts and conversations are gone through whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ravelin.llm.common import kept_table

BLOCK = 4  #: symbols in a block: SYMBOLS ** BLOCK blocks have a row in the table
CHUNK_ROWS, CHUNK_CHARS = 4096, 4 << 20  #: a conversation held in memory at once; longer ones are cut into such chunks

KEEP, REROLE, DELETE, INSERT, BROKEN_OFF = 0, 2, 3, 2, 1  # fixed values: the costs of edits
WHITE, STOPS = " \t\n\x0b\x0c\r", ".!?"  # fixed values
START, SYSTEM, USER, ASSISTANT = range(4)  # states, by the last role
ONWARD = (USER, USER, ASSISTANT, USER)  # the state after a role is put in, or given to a row
ACCEPTS = (START, ASSISTANT)
CLASSES = "sua"
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
SYMBOLS, GONE = 9, 8  # four classes of initials, each whole or broken off, and rows that must go
LEGAL = {"su", "ua", "au"}


def _with_inserts(h: tuple) -> tuple:
    """Costs from each state if up to two turns may be put in first; more never pay."""
    return tuple(min(h[x], INSERT + h[ONWARD[x]], 2 * INSERT + h[ONWARD[ONWARD[x]]]) for x in range(4))


def _options(after: tuple, symbol: int, x: int) -> list[tuple[int, str, int]]:
    """(cost to the end, letter, next state) of each way to deal with a row from state x."""
    out = [(DELETE + after[x], "D", x)]
    if symbol != GONE:
        more, initial = BROKEN_OFF * (symbol // 4), (*CLASSES, "")[symbol % 4]
        if (initial, x) in KEPT:
            out.append((KEEP + more + after[KEPT[initial, x]], "K", KEPT[initial, x]))
        out.append((REROLE + more + after[ONWARD[x]], "R", ONWARD[x]))
    return out


def _before(after: tuple, symbol: int) -> tuple:
    return _with_inserts(tuple(min(_options(after, symbol, x))[0] for x in range(4)))


def _least(v: tuple) -> tuple[tuple, int]:
    return tuple(x - min(v) for x in v), min(v)


class Tables:
    """Steps over single symbols and whole blocks, and the edits that each row asks for."""

    def __init__(self, block: int = BLOCK) -> None:
        self.block = block
        end = _with_inserts(tuple(0 if x in ACCEPTS else 1 << 40 for x in range(4)))
        self.vectors, at = [end], 0
        known = {end: 0}
        steps: list[list[tuple[int, int]]] = []
        while at < len(self.vectors):
            steps.append([])
            for s in range(SYMBOLS):
                v, less = _least(_before(self.vectors[at], s))
                if v not in known:
                    known[v] = len(self.vectors)
                    self.vectors.append(v)
                steps[-1].append((known[v], less))
            at += 1
        one = np.array(steps).transpose(2, 1, 0)  # (next or cost, symbol, vector)
        self.one_next, self.one_cost = np.ascontiguousarray(one[0]), np.ascontiguousarray(one[1])
        nxt, cost = self.one_next, self.one_cost
        for _ in range(block - 1):  # one symbol more in front
            nxt, cost = self.one_next[:, nxt].reshape(-1, at), (cost + self.one_cost[:, nxt]).reshape(-1, at)
        self.next, self.cost = nxt, cost
        self.moves = [[[self._moves(v, s, x) for x in range(4)] for v in self.vectors] for s in range(SYMBOLS)]

    @staticmethod
    def _moves(after: tuple, symbol: int, x: int) -> tuple[str, int]:
        """The ASCII-least of the cheapest letters that take a row from state x, and the state then."""
        best, letters = _before(after, symbol), ""
        while True:
            found = {letter: to for cost, letter, to in _options(after, symbol, x) if cost == best[x]}
            if "D" not in found and INSERT + best[ONWARD[x]] == best[x]:
                letters, x = letters + "I", ONWARD[x]
                continue
            letter = min(found)
            return letters + letter, found[letter]

    def cut(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading symbols that fill no block, and the codes of the blocks that follow."""
        lead = len(symbols) % self.block
        codes = symbols[lead:].astype(np.int64).reshape(-1, self.block) @ (SYMBOLS ** np.arange(self.block - 1, -1, -1))
        return symbols[:lead], codes

    def step(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector after these symbols: the vector before them, and the cost between."""
        v = np.arange(len(self.vectors))
        cost = np.zeros(len(v), np.int64)
        lead, codes = self.cut(symbols)
        for c in codes[::-1]:
            cost, v = cost + self.cost[c, v], self.next[c, v]
        for s in lead[::-1]:
            cost, v = cost + self.one_cost[s, v], self.one_next[s, v]
        return v, cost

    def cost_of(self, symbols: np.ndarray, v: int = 0) -> tuple[int, int, list[int]]:
        """The vector before these symbols, the cost between, and the vectors after each block; v: that after them all."""
        lead, codes = self.cut(symbols)
        after, cost = [], 0
        for c in codes[::-1].tolist():
            after.append(v)
            cost, v = cost + int(self.cost[c, v]), int(self.next[c, v])
        after.append(v)
        for s in lead[::-1].tolist():
            cost, v = cost + int(self.one_cost[s, v]), int(self.one_next[s, v])
        return v, cost, after[::-1]

    def traced(self, symbols: np.ndarray, state: int, v: int = 0) -> tuple[list[str], int]:
        """The letters of each row from a state on, and the state after the last; v: the vector after these symbols."""
        after = self.cost_of(symbols, v)[2]
        lead, out = len(symbols) % self.block, []
        for k, v in enumerate(after):
            lo, hi = (0, lead) if k == 0 else (lead + (k - 1) * self.block, lead + k * self.block)
            own = symbols[lo:hi].tolist()
            inner = [v]
            for s in own[:0:-1]:  # the block backwards: the vector after each of its rows
                inner.append(int(self.one_next[s, inner[-1]]))
            for s, w in zip(own, inner[::-1], strict=True) if own else ():
                letters, state = self.moves[s][w][state]
                out.append(letters)
        return out, state

    @staticmethod
    def closing(state: int) -> str:
        """Turns put in after the last row."""
        return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


@cache
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


def stripped(text: str) -> str:
    return text.strip(WHITE)


def symbol_of(role: str, text: str, seen: bool) -> tuple[int, int]:
    """The symbol of a row and its first fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    inner = stripped(text)
    if not inner or seen:
        return GONE, 1 if not inner else 2
    broken, cls = inner[-1] not in STOPS, CLASSES.find(role[:1]) if role else -1
    return (3 if cls < 0 else cls) + 4 * broken, 3 * broken


def lines(rows: list[tuple], letters: list[str], closing: str, state: int = START) -> list[str]:
    """`role:text` of each repaired row. rows: (role, text)."""
    out = []

    def put(text: str, role: str | None = None) -> None:
        nonlocal state
        to = ONWARD[state]
        out.append(f"{role if role is not None else ('user' if to == USER else 'assistant')}:{text}")
        state = to if role is None else KEPT[role[:1], state]

    for (role, text), edits in zip(rows, letters, strict=True):
        for e in edits:
            if e == "I":
                put("")
            elif e == "R":
                put(text)
            elif e == "K":
                put(text, role)
    for _ in closing:
        put("")
    return out


def sha(parts: list[str]) -> str:
    return hashlib.sha256("\n".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def gaps_of(turns: list) -> int:
    have = [t for t in turns if t is not None]
    return max(have) - min(have) + 1 - len(set(have)) if have else 0


def illegal_of(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in pairwise(roles))


def repaired(rows: list[tuple], t: Tables) -> tuple:
    """The figures of a conversation that is held whole. rows: (turn, role, text) in order."""
    seen, symbols, faults = set(), [], [0, 0, 0, 0]
    for _, role, text in rows:
        s, f = symbol_of(role, text, (role, text) in seen)
        seen.add((role, text))
        symbols.append(s)
        faults[f] += 1
    symbols = np.array(symbols, np.uint8)
    v, cost, _ = t.cost_of(symbols)
    letters, state = t.traced(symbols, START)
    closing = t.closing(state)
    out = lines([r[1:] for r in rows], letters, closing)
    return (gaps_of([r[0] for r in rows]), *faults[1:], illegal_of([r[1] for r in rows]), cost + t.vectors[v][START], "".join(letters) + closing, sha(out))


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_FIGURES = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in FIGURES)
_CHUNK = "seg long, turns array<long>, roles array<string>, texts array<string>"


def _schema(kind: str, rest: str) -> StructType:
    return StructType.fromDDL(f"conv_id {kind}, {rest}")


class _Writer:
    """Rows gathered into batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 2000, chars: int = 8 << 20) -> None:
        self.schema, self.rows, self.chars, self.held, self.size = schema, rows, chars, [], 0

    def add(self, row: tuple, size: int = 100) -> Iterator[pa.RecordBatch]:
        self.held.append(row)
        self.size += size
        if len(self.held) >= self.rows or self.size >= self.chars:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.held, strict=True), self.schema, strict=True)], schema=self.schema)
        self.held, self.size = [], 0


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _mapped(df: DataFrame, make, schema: StructType) -> DataFrame:
    """df through make(rows) -> (row, its size), row by row and in order; batches are bounded by rows and size."""
    wanted = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(wanted)
        for row, size in make(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            yield from out.add(row, size)
        yield from out.rest()

    return df.mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows dealt their damage by crc32 of `conv_id:turn`; a row that is dropped stays as one of null text."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    h, text = F.crc32(key) % 20, F.coalesce(F.col("text").cast("string"), space)
    text = F.when(h == 1, "").when(h == 2, F.translate(text, STOPS, "")).when(h > 0, text)
    role = F.when(h == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), space))
    made = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(h == 3, 2).otherwise(1).alias("times"))
    return made.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("again")).drop("again")


def _first_pass(chunk_rows: int, chunk_chars: int, block: int):
    """Ordered rows to finished conversations, and to chunks of those that this partition may not hold whole."""

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        seg, t = TaskContext.get().partitionId() << 32, tables(block)
        held, size, conv, whole, begun = [], 0, None, False, False

        def chunk() -> tuple:
            nonlocal seg, held, size
            live = [r for r in held if r[2] is not None]
            row = (conv, False, *(None,) * len(FIGURES), seg, *([r[k] for r in live] for k in range(3)))
            seg, out = seg + 1, (row, size)
            held, size = [], 0
            return out

        def done() -> tuple:
            nonlocal held, size
            made = repaired([r for r in held if r[2] is not None], t)
            held, size = [], 0
            return (conv, True, *made, None, None, None, None), 200 + len(made[-2])

        for c, *row in rows:
            if not begun or c != conv:
                if begun:
                    yield done() if whole else chunk()
                conv, whole, begun = c, begun, True  # the first of a partition may have begun in another
            elif len(held) >= chunk_rows or size >= chunk_chars:
                whole = False
                yield chunk()
            held.append(row)
            size += len(row[2] or "") + 50
        if begun:
            yield chunk()  # the last may go on in another

    return make


def _summary(block: int):
    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        t = tables(block)
        for conv, seg, turns, roles, texts, firsts in rows:
            first, faults, symbols = set(firsts or ()), [0] * 4, bytearray()
            for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
                s, f = symbol_of(role, text, i not in first)
                symbols.append(s)
                faults[f] += 1
            nxt, cost = t.step(np.frombuffer(bytes(symbols), np.uint8))
            have = [x for x in turns if x is not None]
            span = (have[0], have[-1], len(set(have))) if have else (None, None, 0)
            ends = (roles[0][:1], roles[-1][:1]) if roles else (None, None)
            yield (conv, seg, bytes(symbols), nxt.tolist(), cost.tolist(), *faults[1:], illegal_of(roles), *span, *ends), 300 + len(symbols) + 16 * len(nxt)

    return make


def _backwards(block: int):
    """Chunks of each conversation from its last: the vector after each, and the cost from its start to the end."""

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        t, begun, last, v, cost = tables(block), False, None, 0, 0
        for conv, seg, nxt, costs in rows:
            if not begun or conv != last:
                begun, last, v, cost = True, conv, 0, 0
            after, cost, v = v, cost + costs[v], nxt[v]
            yield (conv, seg, after, cost + t.vectors[v][START]), 60

    return make


def _exits(block: int):
    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        t = tables(block)
        for conv, seg, symbols, after in rows:
            yield (conv, seg, [t.traced(np.frombuffer(symbols, np.uint8), x, after)[1] for x in range(4)]), 60

    return make


def _forwards(rows: Iterator[tuple]) -> Iterator[tuple]:
    begun, last, state = False, None, START
    for conv, seg, exits in rows:
        if not begun or conv != last:
            begun, last, state = True, conv, START
        yield (conv, seg, state), 60
        state = exits[state]


def _pieces(block: int):
    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        t = tables(block)
        for conv, seg, roles, texts, symbols, after, state, *rest in rows:
            letters, out = t.traced(np.frombuffer(symbols, np.uint8), state, after)
            piece = "\n".join(x := lines(list(zip(roles, texts, strict=True)), letters, "", state))
            yield (conv, seg, "".join(letters), out, len(x), piece, *rest), 200 + len(piece)

    return make


def _joined(block: int):
    """Chunks of each conversation in order to its figures. One chunk is held at a time, and the audit."""

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        t, begun, conv = tables(block), False, None

        def done() -> tuple:
            if n_lines or t.closing(state):
                close(lines([], [], t.closing(state), state))
            gaps = high - low + 1 - distinct if low is not None else 0
            return (conv, gaps, *faults, illegal, cost, "".join(audit) + t.closing(state), digest.hexdigest()), 300 + sum(map(len, audit))

        def close(more: list[str]) -> None:
            nonlocal n_lines
            for x in more:
                digest.update((("\n" if n_lines else "") + x).encode("utf-8", "surrogatepass"))
                n_lines += 1

        for c, _, letters, out, n, piece, blank, duplicate, truncated, odd, lo, hi, own, one, other, from_here in rows:
            if not begun or c != conv:
                if begun:
                    yield done()
                begun, conv, digest, n_lines, audit, faults, illegal, cost = True, c, hashlib.sha256(), 0, [], [0] * 3, 0, from_here
                low = high = before = None
                distinct = 0
            faults = [x + y for x, y in zip(faults, (blank, duplicate, truncated), strict=True)]
            illegal += odd + (before is not None and one is not None and before + one not in LEGAL)
            before = other if other is not None else before
            if lo is not None:
                distinct += own - (high == lo)
                low, high = lo if low is None else low, hi
            audit.append(letters)
            state = out
            if n:
                close([piece])
                n_lines += n - 1
        if begun:
            yield done()

    return make


def repair(
    conversations: DataFrame, *, chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS, block: int = BLOCK, damage: bool = True,
) -> DataFrame:
    """One row per conv_id: gaps, faults, the cost of the cheapest edits, their letters and the hash of the repaired rows.

    damage: deal rows the stated damage first; else they are repaired as they are.
    """
    cols = [F.col("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))]
    rows = damaged(conversations) if damage else conversations.select(*cols)
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "sum", "at"]
    rows = rows.withColumns({"sum": F.crc32("text"), "at": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("sum", "at")
    first = kept_table(_mapped(rows, _first_pass(chunk_rows, chunk_chars, block), _schema(kind, f"done boolean, {_FIGURES}, {_CHUNK}")), "repaired")
    chunks = first.where("NOT done").select("conv_id", "seg", "turns", "roles", "texts")
    at = chunks.select("conv_id", "seg", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "x"))
    key = [F.xxhash64("x.roles", "x.texts").alias("a"), F.xxhash64(F.lit(1), "x.texts", "x.roles").alias("b")]
    firsts = at.groupBy("conv_id", *key).agg(F.min(F.struct("seg", "pos")).alias("m")).groupBy(F.col("m.seg").alias("seg")).agg(F.collect_list("m.pos").alias("firsts"))
    turn = "low long, high long, turns long, one string, other string"
    state = _schema(kind, f"seg long, symbols binary, nxt array<long>, costs array<long>, blank long, duplicate long, truncated long, illegal long, {turn}")
    summary = kept_table(_mapped(chunks.join(firsts, "seg", "left").select(*chunks.columns, "firsts"), _summary(block), state), "summary")
    last_first = summary.select("conv_id", "seg", "nxt", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seg"))
    after = kept_table(_mapped(last_first, _backwards(block), _schema(kind, "seg long, after long, cost long")), "after")
    traced = summary.select("conv_id", "seg", "symbols").join(after.select("seg", "after"), "seg").select("conv_id", "seg", "symbols", "after")
    exits = _mapped(traced, _exits(block), _schema(kind, "seg long, exits array<long>"))
    states = kept_table(_mapped(exits.repartition("conv_id").sortWithinPartitions("conv_id", "seg"), _forwards, _schema(kind, "seg long, state long")), "states")
    rest = ["blank", "duplicate", "truncated", "illegal", "low", "high", "turns", "one", "other", "cost"]
    whole = summary.join(after.select("seg", "after", "cost"), "seg").join(states.select("seg", "state"), "seg").join(chunks.select("seg", "roles", "texts"), "seg")
    whole = whole.select("conv_id", "seg", "roles", "texts", "symbols", "after", "state", *rest)
    given = f"seg long, letters string, state long, n long, piece string, blank long, duplicate long, truncated long, illegal long, {turn}, cost long"
    pieces = _mapped(whole, _pieces(block), _schema(kind, given)).repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    cut = _mapped(pieces, _joined(block), _schema(kind, _FIGURES))
    return first.where("done").select("conv_id", *FIGURES).unionByName(cut)
