"""Chat formatting by minimum-cost role repair.

Legal conversations: at most one system turn, at the start; then user and assistant turns in
alternation, where tool turns may stand between an assistant turn and the next. They
end with a user or assistant turn. For each turn, repair chooses a role (another one than it has costs
``RELABEL``, or ``NAME`` where its label is unknown) and either begins a turn, or merges it into the one before
it, of the same role (``MERGE``), or first inserts empty turns (``INSERT`` each). The cheapest sequence of
choices is found by dynamic programming over the automaton, whose state is the role of the last turn.
Of equally cheap ones, the one whose states come first in ``ROLES``, from the end, is taken.

A conversation may hold a third of all rows. So rows are sorted into ranges, and a range is solved
by itself: the cost of crossing it from every state to every state is a small matrix, and matrices
of the ranges that one conversation crosses are multiplied in the min-plus algebra. The driver gets two rows
a range. Then every range is walked back, first from every state, then from the right one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

ROLES = ("user", "assistant", "tool", "system")
START, END = 4, 5
RELABEL, NAME, MERGE, INSERT = 3, 1, 1, 2
FAR = 10**9
#: Role that may follow: by the role before it, START for none; END is the end of the conversation.
NEXT = {START: (0, 3), 3: (0,), 0: (1, END), 1: (0, 2, END), 2: (1, 2)}
#: Other names of the roles.
NAMES = {"user": 0, "human": 0, "prompter": 0, "assistant": 1, "bot": 1, "gpt": 1, "model": 1, "tool": 2, "function": 2, "system": 3, "developer": 3}
OPEN, CLOSE, JOINT = "<|im_start|>", "<|im_end|>\n", "\n\n"
Vector = tuple[int, ...]


@cache
def inserted(s: int, r: int) -> tuple[int, ...] | None:
    """The fewest roles to insert between s and r; None if there is no way (a system turn after the start)."""
    paths: list[tuple[int, ...]] = [()]
    for _ in range(4):
        for p in paths:
            if r in NEXT[p[-1] if p else s]:
                return p
        paths = [(*p, x) for p in paths for x in NEXT[p[-1] if p else s] if x not in (3, END)]
    return None


@cache
def step(s: int, label: int, r: int) -> tuple[int, bool]:
    """Cost of giving a turn with that label the role r after role s, and whether it merges. label: -1 if unknown."""
    cost = NAME if label < 0 else 0 if label == r else RELABEL
    way = inserted(s, r)
    apart = FAR if way is None else INSERT * len(way)
    return (cost + MERGE, True) if s == r and apart > MERGE else (cost + apart, False)


@cache
def forward(v: Vector, label: int) -> Vector:
    """Least cost to be in each state after one more turn."""
    return tuple(min(FAR, *(v[s] + step(s, label, r)[0] for s in range(5) if v[s] < FAR)) if r < 4 else FAR for r in range(5))


@cache
def before(v: Vector, label: int, r: int) -> int:
    """The state that the cheapest way to r comes from."""
    return min((v[s] + step(s, label, r)[0], s) for s in range(5))[1]


@cache
def last(v: Vector) -> int:
    """The state in which the cheapest conversation ends."""
    return min((v[s] + INSERT * len(inserted(s, END) or ()), s) for s in range(4))[1]


def unit_vector(s: int) -> Vector:
    return tuple(0 if x == s else FAR for x in range(5))


def less(v: Vector) -> tuple[Vector, int]:
    """The same vector with least value 0, and what was taken off: few vectors differ then, so ``forward`` meets them again."""
    low = min(v)
    return tuple(FAR if x >= FAR // 2 else x - low for x in v), low


def vectors(v: Vector, labels: list[int]) -> list[Vector]:
    """The vector before each turn and the one at the end, each with least value 0."""
    out = [less(v)[0]]
    for x in labels:
        out.append(less(forward(out[-1], x))[0])
    return out


def crossing(labels: list[int]) -> list[list[int]]:
    """Least cost from each state before the turns to each state after them."""
    out = []
    for s in range(5):
        v, total = unit_vector(s), 0
        for x in labels:
            v, low = less(forward(v, x))
            total += low
        out.append([min(FAR, x + total) if x < FAR else FAR for x in v])
    return out


def times(v: Vector, m: list[list[int]]) -> Vector:
    return less(tuple(min(FAR, *(v[s] + m[s][r] for s in range(5))) for r in range(5)))[0]


def walk_back(vs: list[Vector], labels: list[int], end: int) -> list[int]:
    """The state before each turn and the one at the end."""
    out = [end]
    for v, x in zip(vs[-2::-1], labels[::-1], strict=True):
        out.append(before(v, x, out[-1]))
    return out[::-1]


def ordered(rows: DataFrame) -> DataFrame:
    """The rows sorted by conversation and turn, with range (part) and place in it (at), as a written table.

    A part's file is one row group, so a task that reads it has all of its rows, in order.
    """
    text = F.coalesce("text", F.lit(""))
    known = F.create_map(*[x for k, v in NAMES.items() for x in (F.lit(k), F.lit(v))])
    rows = rows.select("conv_id", "turn", "role", text.alias("text"), F.coalesce(known[F.lower(F.trim("role"))], F.lit(-1)).alias("label"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("n"))
    order = ["conv_id", "turn", "role", "h", "n"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("h", "n")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return scratch.table(rows.select("*", F.spark_partition_id().alias("part"), at.alias("at")), "turns", "zstd", {"parquet.block.size": str(1 << 31)})


def _segments(batches: Iterator[pa.RecordBatch], more: bool) -> Iterator[tuple[int, int, list[dict]]]:
    """(part, nth conversation of it, rows) of each conversation of each part. more: whether texts are wanted."""
    part = conv = None
    nth, found = 0, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["part"] != part or r["conv_id"] != conv:
                if found:
                    yield part, nth, found
                nth = nth + 1 if r["part"] == part else 0
                if r["at"] != (0 if r["part"] != part else found[-1]["at"] + 1):
                    raise ValueError("a range of turns was read in part")
                part, conv, found = r["part"], r["conv_id"], []
            found.append(r)
    if found:
        yield part, nth, found


def _ends(turns: DataFrame) -> list[dict]:
    """First and last conversation of each part, in order of parts: size, matrix, nth of how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(part: int, nth: int, rows: list[dict]) -> dict:
            return {"part": part, "nth": nth, "conv_id": rows[0]["conv_id"], "n": len(rows), "m": [x for y in crossing([r["label"] for r in rows]) for x in y]}

        held: tuple | None = None
        out = []
        for part, nth, rows in _segments(batches, False):
            if held and held[0] != part and held[1]:
                out.append(row(*held))
            if nth == 0:
                out.append(row(part, nth, rows))
            held = (part, nth, rows)
        if held and held[1]:
            out.append(row(*held))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([("part", pa.int32()), ("nth", pa.int64()), ("conv_id", _arrow(turns, "conv_id")), ("n", pa.int64()), ("m", pa.list_(pa.int64()))])
    got = turns.select("conv_id", "label", "part", "at").mapInArrow(run, f"part int, nth long, conv_id {kind}, n long, m array<long>").collect()
    return sorted((r.asDict() for r in got), key=lambda r: (r["part"], r["nth"]))


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _chains(ends: list[dict]) -> list[list[dict]]:
    """Segments of conversations that cross from a part to the next; ends: in order."""
    out, chain = [], []
    for r in ends:
        if chain and chain[-1]["conv_id"] == r["conv_id"] and chain[-1]["part"] != r["part"]:
            chain.append(r)
        else:
            out += [chain] if len(chain) > 1 else []
            chain = [r]
    return out + ([chain] if len(chain) > 1 else [])


def _entries(turns: DataFrame, entry: dict[tuple[int, int], Vector]) -> dict[tuple[int, int], list[int]]:
    """For each segment of a chain: the state before it, by the state after it."""
    parts = sorted({p for p, _ in entry})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for part, nth, rows in _segments(batches, False):
            if (part, nth) in entry:
                labels = [r["label"] for r in rows]
                vs = vectors(entry[part, nth], labels)
                out.append({"part": part, "nth": nth, "came": [walk_back(vs, labels, e)[0] for e in range(4)]})
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("nth", pa.int64()), ("came", pa.list_(pa.int64()))]))

    some = turns.select("conv_id", "label", "part", "at").where(F.col("part").isin(parts))
    return {(r["part"], r["nth"]): r["came"] for r in some.mapInArrow(run, "part int, nth long, came array<long>").collect()}


def repair(conversations: DataFrame) -> DataFrame:
    """Repair the roles of conversations, and render them.

    conversations: conv_id, turn, role, text; other columns are ignored. Returns one row per input row: conv_id, turn,
    place (from 0, in its conversation), role, new_role, action (keep, relabel, merge or relabel+merge), inserted (roles of empty
    turns put before it, by commas), appended (of those put after the last), rendered. A conversation's transcript is its rendered
    pieces in order of place. Turns are ordered by turn (null first), then role and text, so repeated rows stand together.
    Null text is empty; a null or strange role is unknown and gets whichever costs least; rows of null conv_id are one
    conversation. Markers inside texts are broken up by a space. An empty table gives an empty result.
    """
    turns = ordered(conversations)
    chains = _chains(_ends(turns))
    entry, offset, exit_, firsts, finals = {}, {}, {}, set(), set()
    for chain in chains:
        v, n = unit_vector(START), 0
        for r in chain:
            entry[r["part"], r["nth"]], offset[r["part"], r["nth"]] = v, n
            v, n = times(v, [r["m"][i : i + 5] for i in range(0, 25, 5)]), n + r["n"]
        exit_[chain[-1]["part"], chain[-1]["nth"]] = last(v)
        firsts.add((chain[0]["part"], chain[0]["nth"]))
        finals.add((chain[-1]["part"], chain[-1]["nth"]))
    came = _entries(turns, entry) if chains else {}
    for chain in chains:
        for a, b in zip(chain[-2::-1], chain[:0:-1], strict=True):
            b = b["part"], b["nth"]
            exit_[a["part"], a["nth"]] = came[b][exit_[b]]
    kind = turns.schema["conv_id"].dataType.simpleString(), turns.schema["turn"].dataType.simpleString(), turns.schema["role"].dataType.simpleString()
    schema = pa.schema(
        [("conv_id", _arrow(turns, "conv_id")), ("turn", _arrow(turns, "turn")), ("place", pa.int64()), ("role", _arrow(turns, "role"))]
        + [(x, pa.string()) for x in ("new_role", "action", "inserted", "appended", "rendered")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for part, nth, rows in _segments(batches, True):
            key, labels = (part, nth), [r["label"] for r in rows]
            vs = vectors(entry.get(key, unit_vector(START)), labels)
            states = walk_back(vs, labels, exit_[key] if key in exit_ else last(vs[-1]))
            for i, r in enumerate(rows):
                s, new = states[i], states[i + 1]
                merges = step(s, labels[i], new)[1]
                extra = () if merges else inserted(s, new)
                begins = i == 0 and (key not in entry or key in firsts)
                ends = i == len(rows) - 1 and (key not in entry or key in finals)
                after = (inserted(new, END) or ()) if ends else ()
                text = r["text"].replace("<|im_start|>", "<| im_start |>").replace("<|im_end|>", "<| im_end |>")
                piece = JOINT + text if merges else ("" if begins else CLOSE) + "".join(f"{OPEN}{ROLES[x]}\n{CLOSE}" for x in extra) + f"{OPEN}{ROLES[new]}\n{text}"
                piece += (CLOSE + "".join(f"{OPEN}{ROLES[x]}\n{CLOSE}" for x in after)) if ends else ""
                did = [x for x, y in (("relabel", labels[i] != new), ("merge", merges)) if y]
                out.append({
                    "conv_id": r["conv_id"], "turn": r["turn"], "place": offset.get(key, 0) + i, "role": r["role"], "new_role": ROLES[new], "action": "+".join(did) or "keep",
                    "inserted": ",".join(ROLES[x] for x in extra), "appended": ",".join(ROLES[x] for x in after), "rendered": piece,
                })
                size += len(piece)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return turns.mapInArrow(run, f"conv_id {kind[0]}, turn {kind[1]}, place long, role {kind[2]}, new_role string, action string, inserted string, appended string, rendered string")


def cheapest(labels: list[int]) -> tuple[int, list[int]]:
    """Cost and roles of one conversation's cheapest repair, in one go."""
    v, total = unit_vector(START), 0
    for x in labels:
        v, low = less(forward(v, x))
        total += low
    end = last(v)
    total += v[end] + INSERT * len(inserted(end, END) or ())
    return total, walk_back(vectors(unit_vector(START), labels), labels, end)[1:]
