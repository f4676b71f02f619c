"""Conversation structure repair: cheapest edits by a parallel Viterbi search.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``.  Rows
are kept, given another role or deleted, and empty rows are inserted, at least
cost; of equally cheap repairs the one whose audit (initials of the edits, in
order) is least in ASCII wins.  The search has four states: nothing yet, after
the system's row, after the user's, after the assistant's.  What the rest of a
conversation costs from each state is a vector of four numbers; a row turns the
vector behind it into the one before it.  Only differences matter and few
vectors exist, so a step is looked up once and remembered.

Rows are range partitioned by conversation and turn, so a conversation of any
size is spread over as many tasks as its rows ask for.  Conversations that lie
within a task are finished there.  The others are chunks, at most two a task: each
searches backwards from a speculative vector, then takes the vector that
the next chunk came to and is searched anew wherever that one differs by more
than a constant, until none does.  The vectors then lead the trace: forwards,
the least letter that stays cheapest.  Should passes not converge (long rows of
roles without a place keep two vectors apart), chunks are searched from the unit vectors, which
give every other vector as a sum.

A conversation's digest is one SHA-256, which runs over its repaired text from
start to end; that is streamed, in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefloom.llm.common import Stages

# a conversation is handed on in pieces of at most so many rows or about so many characters
PIECE_ROWS, PIECE_CHARS = 1024, 1 << 22
# fix-up passes before the unit vectors
PASSES = 6

Vector = tuple[float, float, float, float]
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_INF = float("inf")
# where an inserted row leads, and whose it is; a row's new role is the same
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
# where a kept row of an initial leads
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_CLASSES = "sua?"
_SPACES = " \t\n\x0b\x0c\r"
# a row that must go; others are 1 + 2 * class, and 1 more where truncated
GONE = 0
UNITS = tuple(tuple(0.0 if i == j else _INF for j in range(4)) for i in range(4))


def closed(vector) -> Vector:
    """With rows inserted where that is cheaper."""
    v = list(vector)
    for _ in range(3):
        v = [min(v[s], INSERT + v[_NEXT[s]]) for s in range(4)]
    return tuple(v)


END: Vector = closed((0.0, _INF, _INF, 0.0))


def edits(state: int, code: int) -> Iterator[tuple[str, float, int]]:
    """``(letter, cost, state after it)`` of what can become of a row."""
    yield "D", DELETE, state
    if code != GONE:
        kind, truncated = divmod(code - 1, 2)
        to = _KEPT.get(_CLASSES[kind], {}).get(state)
        if to is not None:
            yield "K", KEEP + truncated * TRUNCATED, to
        yield "R", REROLE + truncated * TRUNCATED, _NEXT[state]


class Search:
    """Steps of the search, each worked out once."""

    def __init__(self):
        self.before: dict[tuple[Vector, int], tuple[Vector, float]] = {}
        self.taken: dict[tuple[int, int, Vector], tuple[str, int, float]] = {}

    def backwards(self, code: int, after: Vector) -> tuple[Vector, float]:
        """The vector before a row, its least entry taken out and given back."""
        found = self.before.get((after, code))
        if found is None:
            v = closed(min(cost + after[to] for _, cost, to in edits(s, code)) for s in range(4))
            least = min(v)
            found = self.before[after, code] = tuple(x - least for x in v), least
        return found

    def forwards(self, state: int, code: int, after: Vector) -> tuple[str, int, float]:
        """Letters up to and with a row, the state after it, and their cost: the least letters of the cheapest."""
        found = self.taken.get((state, code, after))
        if found is None:
            at, letters, total = state, "", 0.0
            while not letters or letters[-1] == "I":
                here = {s: min(cost + after[to] for _, cost, to in edits(s, code)) for s in range(4)}
                v = closed(here.values())
                ways = [(letter, cost, to) for letter, cost, to in edits(at, code) if cost + after[to] == v[at]]
                if INSERT + v[_NEXT[at]] == v[at]:
                    ways.append(("I", INSERT, _NEXT[at]))
                letter, cost, at = min(ways)
                letters, total = letters + letter, total + cost
            found = self.taken[state, code, after] = letters, at, total
        return found

    def chunk(self, codes: bytes, end: Vector) -> list[Vector]:
        """The vector behind each row, and before the first one: last to first."""
        out = [end]
        for code in reversed(codes):
            out.append(self.backwards(code, out[-1])[0])
        return out

    def ends(self, codes: bytes, vectors: list[Vector]) -> list[int]:
        """The state after the last row, from each state before the first."""
        states = list(range(4))
        for i, code in enumerate(codes):
            after = vectors[len(codes) - 1 - i]
            step = {s: self.forwards(s, code, after)[1] for s in set(states)}
            states = [step[s] for s in states]
        return states


def closing(state: int) -> str:
    """Rows inserted behind the last one."""
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


@dataclass
class Piece:
    """Consecutive rows of a conversation, and what they count."""

    codes: bytearray = field(default_factory=bytearray)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0  # distinct ones
    turn_min: int | None = None  # of turns in order, also the first
    turn_max: int | None = None
    chars: int = 0

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        said = text.rstrip(_SPACES)
        if not said:
            self.blank += 1
            code = GONE
        elif again:
            self.duplicate += 1
            code = GONE
        else:
            cut = said[-1] not in ".!?"
            self.truncated += cut
            code = 1 + 2 * "sua".find(role[:1] or "?") + cut if role[:1] in ("s", "u", "a") else 1 + 2 * 3 + cut
        if self.roles:
            self.illegal += _pair(self.roles[-1][:1], role[:1])
        if turn is not None:
            self.turns += turn != self.turn_max
            self.turn_min = turn if self.turn_min is None else self.turn_min
            self.turn_max = turn
        self.codes.append(code)
        self.roles.append(role)
        # a row that must go is needed no more
        self.texts.append("" if code == GONE else text)
        self.chars += len(role) + len(text)

    def full(self) -> bool:
        return len(self.codes) >= PIECE_ROWS or self.chars >= PIECE_CHARS

    def counts(self) -> dict:
        return {
            "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "turns": self.turns,
            "turn_min": self.turn_min, "turn_max": self.turn_max, "first": self.roles[0][:1] if self.roles else None,
            "last": self.roles[-1][:1] if self.roles else None,
        }


def _pair(one: str, two: str) -> bool:
    return one + two not in ("su", "ua", "au")


def render(letters: list[str], roles: list[str], texts: list[str], state: int) -> list[str]:
    """Repaired rows: ``letters`` holds a row's inserts and its own edit; one more entry closes a conversation."""
    lines = []
    for i, some in enumerate(letters):
        for letter in some:
            if letter == "I":
                state = _NEXT[state]
                lines.append(f"{_ROLE[state]}:")
            elif letter == "K":
                state = _KEPT[roles[i][0]][state]
                lines.append(f"{roles[i]}:{texts[i]}")
            elif letter == "R":
                state = _NEXT[state]
                lines.append(f"{_ROLE[state]}:{texts[i]}")
    return lines


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` -> the same and ``dropped``, damaged by a hash of conversation and turn.

    Nulls are one space.  Of twenty hashes 0 drops a row (it is marked, so its
    conversation stays known), 1 empties its text, 2 takes ``.!?`` out of it,
    3 repeats it, 4 makes it the user's; the others leave it alone.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    place = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), plain("role").alias("role"), plain("text").alias("text"), place.alias("_place"))
    text = F.when(F.col("_place") == 1, "").when(F.col("_place") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_place") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.col("_place") == 0, F.when(F.col("_place") == 3, 2).otherwise(1))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("dropped"))


_COUNTS = [("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("turns", pa.int64()),
           ("turn_min", pa.int64()), ("turn_max", pa.int64()), ("first", pa.string()), ("last", pa.string())]
_COUNTS_SQL = ", ".join(f"{n} {'STRING' if t == pa.string() else 'BIGINT'}" for n, t in _COUNTS)
_FOUND = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _found(counts: dict, cost: float, audit: str, digest: str) -> dict:
    gaps = 0 if counts["turn_min"] is None else counts["turn_max"] - counts["turn_min"] + 1 - counts["turns"]
    return {**{c: counts[c] for c in _FOUND[1:5]}, "gaps": gaps, "cost": int(cost), "audit": audit, "repaired_sha256": digest}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> a row per conversation that is done here, and the pieces of those that may go on elsewhere."""
    part, run, search, schema = TaskContext.get().partitionId(), 0, Search(), None
    known, conv, last, no, piece, out = False, None, None, 0, Piece(), []

    def handed(done: bool) -> dict:
        return {
            "conv_id": conv, "part": part, "run": run, "no": no, "at_end": done, "codes": bytes(piece.codes), "roles": piece.roles,
            "texts": piece.texts, **piece.counts(),
        }

    def closed_run() -> dict:
        if run == 0 or no:
            return handed(False)
        vectors, state, letters, cost = search.chunk(piece.codes, END), START, [], 0.0
        for i, code in enumerate(piece.codes):
            some, state, more = search.forwards(state, code, vectors[len(piece.codes) - 1 - i])
            letters.append(some)
            cost += more
        letters.append(closing(state))
        text = "\n".join(render(letters, piece.roles, piece.texts, START)).encode("utf-8", "surrogatepass")
        found = _found(piece.counts(), cost + INSERT * len(letters[-1]), "".join(letters), hashlib.sha256(text).hexdigest())
        return {"conv_id": conv, "part": part, "run": run, "no": 0, "at_end": False, **found}

    for b in batches:
        if schema is None:
            schema = pa.schema([
                b.schema.field(0), ("part", pa.int32()), ("run", pa.int64()), ("no", pa.int64()), ("at_end", pa.bool_()), ("codes", pa.binary()),
                ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), *_COUNTS, ("gaps", pa.int64()), ("cost", pa.int64()),
                ("audit", pa.string()), ("repaired_sha256", pa.string()),
            ])
        for c, turn, role, text, dropped, again, digest in zip(*(column.to_pylist() for column in b.columns)):
            if not known or c != conv:
                if known:
                    out.append(closed_run())
                    run += 1
                known, conv, last, no, piece = True, c, None, 0, Piece()
            if piece.full():
                out.append(handed(False))
                no, piece = no + 1, Piece()
            if not dropped:
                here = (turn, role, digest)
                piece.add(turn, role, text, again or here == last)
                last = here
            if len(out) >= PIECE_ROWS or piece.full():
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
    if known:
        yield pa.RecordBatch.from_pylist([*out, handed(True)], schema)


def _ordered(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped`` with ``again, digest``, range partitioned and sorted.

    Rows go by turn, nulls first, ties by role and a digest of the text.  A row
    whose role and text stand at an earlier turn of its conversation is there
    ``again``; those that agree in turn as well come to stand side by side.
    """
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    said = rows.where("NOT dropped").groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"))
    several = said.agg(F.min(turn).alias("_first"), F.max(turn).alias("_last")).where("_first <> _last").drop("_last")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    again = F.col("_first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first.turn"))
    marked = rows.join(several, same, "left").select("conv_id", "turn", "role", "text", "dropped", again.alias("again"), "digest")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    return marked.repartitionByRange(*order).sortWithinPartitions(*order)


def _converge(segments: DataFrame, chain: list, passes: int) -> dict:
    """The vector behind each chunk and the state before it: ``(part, run) -> (vector, state)``.

    ``chain`` has the chunks at the borders of tasks, in order: ``(part, run),
    goes on``, at most two a task.
    """
    names = [name for name, _ in chain]
    follows = {name: names[i + 1] for i, (name, goes_on) in enumerate(chain) if goes_on}

    def search(asked: dict) -> dict:
        """Start vectors and end states of some chunks from some vectors."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Search()
            for b in batches:
                out = []
                for part, n, codes in zip(*(b.column(c).to_pylist() for c in ("part", "run", "codes"))):
                    codes = b"".join(codes)
                    for end in asked.get((part, n), ()):
                        vectors = search.chunk(codes, end)
                        states = search.ends(codes, vectors) if end not in UNITS else []
                        total = sum(search.backwards(code, v)[1] for code, v in zip(reversed(codes), vectors))
                        out.append({"part": part, "run": n, "end": list(end), "start": [x + total for x in vectors[-1]], "states": states})
                kinds = [("part", pa.int32()), ("run", pa.int64()), ("end", pa.list_(pa.float64())), ("start", pa.list_(pa.float64())), ("states", pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

        found = segments.mapInArrow(run, "part INT, run BIGINT, end ARRAY<DOUBLE>, start ARRAY<DOUBLE>, states ARRAY<BIGINT>")
        return {(r["part"], r["run"], tuple(r["end"])): (tuple(r["start"]), list(r["states"])) for r in found.collect()}

    def normal(v) -> Vector:
        return tuple(x - min(v) for x in v)

    used = dict.fromkeys(names, END)
    known = search({name: [END] for name in names})
    for _ in range(passes):
        true = {name: normal(known[*follows[name], used[follows[name]]][0]) if name in follows else END for name in names}
        apart = [name for name in names if true[name] != used[name]]
        if not apart:
            break
        known |= search({name: [true[name]] for name in apart if (*name, true[name]) not in known})
        used = true
    else:
        # the vectors still differ somewhere: every vector is a sum of the unit vectors' ones
        open_ones = [name for name in names if name in follows or name in follows.values()]
        units = search({name: list(UNITS) for name in open_ones})
        before: dict = {}
        for name in reversed(names):
            used[name] = normal(before[follows[name]]) if name in follows else END
            if name in open_ones:
                before[name] = closed(
                    min(used[name][k] + units[*name, UNITS[k]][0][s] for k in range(4)) for s in range(4)
                )
        known |= search({name: [used[name]] for name in names if (*name, used[name]) not in known})
    led, state = {}, START
    for name in names:
        led[name] = used[name], state
        state = known[*name, used[name]][1][state] if name in follows else START
    return led


def _traced(segments: DataFrame, led: dict) -> DataFrame:
    """``part, run, no, letters, state, cost``: the edits of each piece's rows and the state before them.

    ``led`` has ``(vector behind it, state before it, whether it is the last)``
    of the chunks at the borders of tasks; others are whole conversations.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search()
        kinds = [("part", pa.int32()), ("run", pa.int64()), ("no", pa.int64()), ("letters", pa.list_(pa.string())), ("state", pa.int64()), ("cost", pa.float64())]
        for b in batches:
            for part, n, pieces in zip(*(b.column(c).to_pylist() for c in ("part", "run", "codes"))):
                end, state, closes = led.get((part, n), (END, START, True))
                codes = b"".join(pieces)
                vectors, left = search.chunk(codes, end), len(codes)
                for no, some in enumerate(pieces):
                    first, letters, cost = state, [], 0.0
                    for code in some:
                        left -= 1
                        edit, state, more = search.forwards(state, code, vectors[left])
                        letters.append(edit)
                        cost += more
                    if closes and no == len(pieces) - 1:
                        letters.append(closing(state))
                        cost += INSERT * len(letters[-1])
                    row = {"part": part, "run": n, "no": no, "letters": letters, "state": first, "cost": cost}
                    yield pa.RecordBatch.from_pylist([row], pa.schema(kinds))

    return segments.mapInArrow(run, "part INT, run BIGINT, no BIGINT, letters ARRAY<STRING>, state BIGINT, cost DOUBLE")


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their letters -> their audit and repaired text."""
    for b in batches:
        audits, texts = [], []
        for letters, state, roles, said in zip(*(b.column(c).to_pylist() for c in ("letters", "state", "roles", "texts"))):
            audits.append("".join(letters))
            texts.append("\n".join(render(letters, roles, said, state)).encode("utf-8", "surrogatepass"))
        kept = [c for c in b.schema.names if c not in ("letters", "state", "roles", "texts")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(audits, pa.string()), pa.array(texts, pa.binary())], [*kept, "audit", "text"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order -> a row per conversation."""
    known, conv, counts, cost, audit, digest, any_text, schema, out = False, None, {}, 0.0, [], None, False, None, []

    def done() -> dict:
        return {"conv_id": conv, **_found(counts, cost, "".join(audit), digest.hexdigest())}

    for b in batches:
        if schema is None:
            numbers = [(c, pa.int64()) for c in _FOUND]
            schema = pa.schema([b.schema.field("conv_id"), *numbers, ("audit", pa.string()), ("repaired_sha256", pa.string())])
        for row in b.to_pylist():
            if not known or row["conv_id"] != conv:
                if known:
                    out.append(done())
                known, conv, cost, audit, digest, any_text = True, row["conv_id"], 0.0, [], hashlib.sha256(), False
                counts = dict.fromkeys((n for n, _ in _COUNTS[:5]), 0) | {"turn_min": None, "turn_max": None, "last": None}
            for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                counts[c] += row[c]
            if row["first"] is not None:
                counts["illegal"] += counts["last"] is not None and _pair(counts["last"], row["first"])
                counts["last"] = row["last"]
            if row["turn_min"] is not None:
                counts["turns"] -= row["turn_min"] == counts["turn_max"]
                counts["turn_min"] = row["turn_min"] if counts["turn_min"] is None else counts["turn_min"]
                counts["turn_max"] = row["turn_max"]
            cost += row["cost"]
            audit.append(row["audit"])
            if row["text"]:
                digest.update((b"\n" if any_text else b"") + row["text"])
                any_text = True
        yield pa.RecordBatch.from_pylist(out, schema)
        out = []
    if known:
        yield pa.RecordBatch.from_pylist([done()], schema)


def repair(rows: DataFrame, stages: Stages, passes: int = PASSES) -> DataFrame:
    """``conv_id, turn, role, text, dropped`` -> a row per conversation: its faults, the cheapest edits, a digest of the repaired text.

    ``role`` and ``text`` are not null.  Rows go by turn, nulls first, ties by
    role and a digest of the text.  Each row's first fault counts: blank,
    duplicate of an earlier row in role and text, truncated.  Conversations
    whose rows are all dropped have zeros, an empty audit and the digest of
    nothing; so does the one of null id, if there is one.  Roles of other
    initials than s, u and a stand nowhere and are given another or deleted.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    found = "gaps BIGINT, cost BIGINT, audit STRING, repaired_sha256 STRING"
    handed = "part INT, run BIGINT, no BIGINT, at_end BOOLEAN, codes BINARY, roles ARRAY<STRING>, texts ARRAY<STRING>"
    ordered = _ordered(rows.select("conv_id", "turn", "role", "text", "dropped"))
    runs = stages.write("runs", ordered.mapInArrow(_runs, f"conv_id {kind}, {handed}, {_COUNTS_SQL}, {found}"))
    pieces = runs.where("codes IS NOT NULL").drop("at_end", *_FOUND[::5], "audit", "repaired_sha256")
    grouped = runs.where("codes IS NOT NULL").groupBy("part", "run").agg(
        F.min("conv_id").alias("conv_id"), F.max("at_end").alias("at_end"), F.sort_array(F.collect_list(F.struct("no", "codes"))).alias("c")
    )
    segments = stages.write("segments", grouped.select("conv_id", "part", "run", "at_end", F.col("c.codes").alias("codes")))
    at_borders = segments.where("run = 0 OR at_end")
    borders = sorted(at_borders.select("part", "run", "at_end", "conv_id").collect())
    chain = [
        ((x["part"], x["run"]), bool(x["at_end"] and y is not None and y["run"] == 0 and x["conv_id"] == y["conv_id"]))
        for x, y in zip(borders, [*borders[1:], None])
    ]
    led = _converge(at_borders, chain, passes)
    traced = _traced(segments, {name: (*led[name], not goes_on) for name, goes_on in chain})
    schema = f"conv_id {kind}, part INT, run BIGINT, no BIGINT, {_COUNTS_SQL}, cost DOUBLE, audit STRING, text BINARY"
    whole = pieces.drop("codes").join(traced, ["part", "run", "no"])
    whole = whole.select("conv_id", "part", "run", "no", *(n for n, _ in _COUNTS), "cost", "letters", "state", "roles", "texts").mapInArrow(_rendered, schema)
    order = [F.col("conv_id").asc_nulls_first(), "part", "run", "no"]
    columns = ["conv_id", *_FOUND, "audit", "repaired_sha256"]
    numbers = ", ".join(f"{c} BIGINT" for c in _FOUND)
    joined = whole.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_joined, f"conv_id {kind}, {numbers}, audit STRING, repaired_sha256 STRING")
    return runs.where("codes IS NULL").select(*columns).unionByName(joined.select(*columns))
