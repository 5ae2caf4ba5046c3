"""Links within groups of any size, tested in tiles of bounded size.

The members of a group are dealt to tiles. A tile holds the group's least member, its centre, as well.
It tests the centre, and then every member that the centre doesn't link, against the other members, and gives
the links that join what is still apart. Members that stay open are then sent to all
tiles of their group, and tested against those that live there. So all pairs of a group are tested but those already joined by way of the
centre; no pairs are written out, and no task holds more than a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

TILE = 192
#: Members, and bytes of their payloads, of small tiles that are tested together.
HELD, HELD_BYTES = 32_768, 1 << 24
#: Given payloads: a function of (a position, which positions are still apart from it) to the positions linked with it.
Tester = Callable[[list[bytes]], Callable[[int, np.ndarray], Iterable[int]]]
#: Given payloads: a function of two arrays of positions to which pairs are linked.
Pairs = Callable[[list[bytes]], Callable[[np.ndarray, np.ndarray], np.ndarray]]
#: Asks which pairs of positions are linked, is sent which are, and ends with all links.
Rounds = Generator[tuple[np.ndarray, np.ndarray], np.ndarray, list[tuple[int, int]]]


def tile_links(n: int, near: Callable[[int, np.ndarray], Iterable[int]], probe: np.ndarray, against: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links (positions) that join all that is linked to a probing member, and each member's component.

    ``probe``: positions to test, in order; ``against``: which positions to test them against. Links within what is
    already one component are left out, as they would join nothing new.
    """
    parent = np.arange(n)
    links = []
    for p in probe.tolist():
        apart = against & (parent != parent[p])
        for q in near(p, apart):  # may look at apart again before each
            if parent[q] != parent[p]:
                links.append((p, int(q)))
                parent[parent == parent[q]] = parent[p]
                np.logical_and(apart, parent != parent[p], out=apart)
    return links, parent


_FIRST, _SECOND = np.zeros(1, np.int64), np.ones(1, np.int64)


def _rounds(probe: np.ndarray, against: np.ndarray, parent: np.ndarray, asked: np.ndarray) -> Rounds:
    """As ``tile_links``, with 2, 4, 8 and so on probing members a round. ``parent`` and ``asked`` (which pairs were tested) are kept up to date."""
    links, a, step = [], 0, 2
    while a < len(probe):
        some, a, step = probe[a : a + step], a + step, 2 * step
        first, second = [], []
        for p in some.tolist():
            apart = np.flatnonzero(against & (parent != parent[p]) & ~asked[p])
            asked[p, apart] = asked[apart, p] = True
            first.append(np.full(len(apart), p))
            second.append(apart)
        first, second = np.concatenate(first), np.concatenate(second)
        if len(first):
            yes = yield first, second
            for p, q in zip(first[yes].tolist(), second[yes].tolist(), strict=True):
                if parent[q] != parent[p]:
                    links.append((p, q))
                    parent[parent == parent[q]] = parent[p]
    return links


def _together(rounds: list[Rounds], raw: list[list[bytes]], pairs: Pairs) -> list[list[tuple[int, int]]]:
    """The links of many tiles: what all ask in a round is tested at once."""
    first = np.cumsum([0, *map(len, raw)])
    linked, out = pairs([x for r in raw for x in r]), [[] for _ in raw]
    answers: dict[int, np.ndarray | None] = dict.fromkeys(range(len(raw)))
    while answers:
        asked = []
        for k, answer in answers.items():
            try:
                asked.append((k, *rounds[k].send(answer)))
            except StopIteration as end:
                out[k] = end.value
        if not asked:
            break
        yes = linked(*(np.concatenate([first[k] + x[side] for k, *x in asked]) for side in range(2)))
        cut = np.cumsum([0, *(len(p) for _, p, _ in asked)]).tolist()
        answers = {k: yes[a:b] for (k, _, _), a, b in zip(asked, cut[:-1], cut[1:], strict=True)}
    return out


class _Tile:
    """Members of one tile, and the next probes: no more of those than a tile has members are held."""

    def __init__(self, centre: int, tester: Tester | None, pairs: Pairs | None = None) -> None:
        self.centre, self.tester, self.pairs = centre, tester, pairs
        self.members, self.probes, self.seen = ([], []), ([], []), set()
        self.links: list[tuple[int, int, bool]] = []

    def add(self, ids: list[int], raw: list[bytes], probing: bool) -> None:
        for i, x in zip(ids, raw, strict=True):
            if (key := (i, probing, hash(x))) not in self.seen:
                self.seen.add(key)
                held = self.probes if probing else self.members  # new ones after each _probe
                held[0].append(i)
                held[1].append(x)
                if probing and len(held[0]) >= TILE:
                    self._probe()

    def _probe(self) -> None:
        n, ids, raw = len(self.members[0]), self.members[0] + self.probes[0], self.members[1] + self.probes[1]
        own = np.arange(len(ids)) < n  # other probes are members of other tiles
        if self.pairs:
            asks = _rounds(np.arange(n, len(ids)), own, np.arange(len(ids)), np.zeros((len(ids),) * 2, dtype=bool))
            links = _together([asks], [raw], self.pairs)[0]
        else:
            links, _ = tile_links(len(ids), self.tester(raw), np.arange(n, len(ids)), own)
        self.links += [(ids[p], ids[q], False) for p, q in links]
        self.seen -= {k for k in self.seen if k[1]}
        self.probes = ([], [])

    def finish(self, probing: bool) -> list[tuple[int, int, bool]]:
        ids = self.members[0]
        if probing:
            if self.probes[0]:
                self._probe()
        elif len(ids) > 1:
            near, every = self.tester(self.members[1]), np.ones(len(ids), dtype=bool)
            first = np.array([ids.index(self.centre)])
            links, parent = tile_links(len(ids), near, first, every)
            apart = np.flatnonzero(parent != parent[first[0]])
            more, _ = tile_links(len(ids), near, apart, every)
            self.links += [(ids[p], ids[q], False) for p, q in links + more] + [(self.centre, ids[p], True) for p in apart]
        return self.links

    def rounds(self) -> Rounds:
        """As ``finish`` of members, for ``_together``."""
        n, centre = len(self.members[0]), self.members[0].index(self.centre)
        if n == 2:  # as most are
            yes = yield _FIRST, _SECOND
            self.links += [] if yes[0] else [(self.centre, self.members[0][1 - centre], True)]
            return [(centre, 1 - centre)] if yes[0] else []
        every, parent, asked = np.ones(n, dtype=bool), np.arange(n), np.zeros((n, n), dtype=bool)
        links = yield from _rounds(np.array([centre]), every, parent, asked)
        apart = np.flatnonzero(parent != parent[centre])
        self.links += [(self.centre, self.members[0][p], True) for p in apart]
        return links + (yield from _rounds(apart, every, parent, asked))


def _finish_together(held: list[_Tile], pairs: Pairs) -> list[tuple[int, int, bool]]:
    """As ``finish`` of the members of each."""
    held = [x for x in held if len(x.members[0]) > 1]
    links = _together([x.rounds() for x in held], [x.members[1] for x in held], pairs)
    return [link for x, own in zip(held, links, strict=True) for link in [*((x.members[0][p], x.members[0][q], False) for p, q in own), *x.links]]


def _verify(rows: DataFrame, tester: Tester | None, probing: bool, pairs: Pairs | None = None) -> DataFrame:
    """rows: centre, tile, id, payload, probe. Gives links a, b, and open members: a = centre, b = id, open.

    Tiles are many and small, so they stream through a sorted partition instead of being grouped one by one.
    Given ``pairs``, those are tested together up to ``HELD`` members.
    """

    def batch_of(links: list[tuple[int, int, bool]]) -> pa.RecordBatch:
        kinds = (("a", pa.int64()), ("b", pa.int64()), ("open", pa.bool_()))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], kind) for k, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile = None, None
        held: list[_Tile] = []
        members = size = 0
        for batch in batches:
            found: list[tuple[int, int, bool]] = []
            centre, number, ids, probe = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("centre", "tile", "id", "probe"))
            raw = batch.column("payload").to_pylist()
            edge = np.flatnonzero((centre[1:] != centre[:-1]) | (number[1:] != number[:-1]) | (probe[1:] != probe[:-1])) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(ids)], strict=True):
                if a == b:
                    continue
                if now != (centre[a], number[a]):
                    if tile and pairs and not probing:
                        held.append(tile)
                        members, size = members + len(tile.members[0]), size + sum(map(len, tile.members[1]))
                        if members >= HELD or size >= HELD_BYTES:
                            found += _finish_together(held, pairs)
                            held, members, size = [], 0, 0
                    elif tile:
                        found += tile.finish(probing)
                    now, tile = (centre[a], number[a]), _Tile(int(centre[a]), tester, pairs)
                tile.add(ids[a:b].tolist(), raw[a:b], bool(probe[a]))
            if found:
                yield batch_of(found)
        if tile:
            yield batch_of(_finish_together([*held, tile], pairs) if pairs and not probing else tile.finish(probing))

    order = ["centre", "tile", "probe", "id"]
    return rows.select(*order, "payload").repartition("centre", "tile").sortWithinPartitions(*order).mapInArrow(run, "a long, b long, open boolean")


def links(near: DataFrame, payloads: Callable[[DataFrame], DataFrame], tester: Tester | None, pairs: Pairs | None = None) -> DataFrame:
    """Links a, b, enough to join all members that are linked with another of their group.

    near: centre, id (without the centre itself), a written table. payloads: given ids, their id and payload (binary).
    Either ``tester`` or ``pairs`` says what is linked; ``pairs`` is asked for many tiles at once.
    """
    count = near.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).withColumn("tiles", F.ceil(F.col("n") / TILE))
    count = scratch.table(count, "tiles")
    dealt = near.join(count, "centre").select("centre", "id", F.pmod(F.xxhash64("id", "centre"), F.col("tiles")).alias("tile"), "tiles")
    heads = count.select("centre", F.col("centre").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), "tiles")
    dealt = scratch.table(dealt.unionByName(heads), "dealt")
    members = scratch.table(payloads(dealt.select("id").distinct()), "payloads")
    rows = dealt.join(members, "id").select("centre", "tile", "id", "payload", F.lit(False).alias("probe"))
    found = scratch.table(_verify(rows, tester, False, pairs), "links")
    left = found.where("open").select(F.col("a").alias("centre"), F.col("b").alias("id"))
    left = left.join(count.where("tiles > 1"), "centre").select("centre", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"))
    left = scratch.table(left, "open")
    reached = left.select("centre").distinct()
    others = dealt.where("tiles > 1").join(reached, "centre", "left_semi").select("centre", "tile", "id", F.lit(False).alias("probe"))
    again = left.select("centre", "tile", "id", F.lit(True).alias("probe")).unionByName(others)
    again = scratch.table(again, "again").join(members, "id").select("centre", "tile", "id", "payload", "probe")
    return found.where("not open").select("a", "b").unionByName(_verify(again, tester, True, pairs).select("a", "b"))
