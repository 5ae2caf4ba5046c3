"""Tools for tests: make a failing case smaller, permute requests, and probe limits."""

from __future__ import annotations

import copy
import hashlib
from collections.abc import Callable, Iterator

from .limits import LIMITS


def smaller(case: list, fails: Callable[[list], bool]) -> list:
    """A sublist that still fails, from which no single element can be left out (delta debugging)."""
    parts = 2
    while len(case) >= 2:
        size = -(-len(case) // parts)
        for a in range(0, len(case), size):
            rest = case[:a] + case[a + size :]
            if rest and fails(rest):
                case, parts = rest, max(parts - 1, 2)
                break
        else:
            if parts >= len(case):
                break
            parts = min(len(case), 2 * parts)
    return case


def minimise(requests: list[dict], fails: Callable[[list[dict]], bool]) -> list[dict]:
    """Fewest requests, then messages of each, then items of each message, that still fail."""
    requests = smaller(copy.deepcopy(requests), fails)
    for k, r in enumerate(requests):

        def with_messages(messages: list, k: int = k, r: dict = r) -> list[dict]:
            return [*requests[:k], r | {"messages": messages}, *requests[k + 1 :]]

        r["messages"] = smaller(r["messages"], lambda m, put=with_messages: fails(put(m)))
        for m in r["messages"]:
            if m.get("content_items"):

                def with_items(items: list, m: dict = m) -> bool:
                    old, m["content_items"] = m["content_items"], items
                    try:
                        return fails(requests)
                    finally:
                        m["content_items"] = old

                m["content_items"] = smaller(m["content_items"], with_items)
    return requests


def permuted(n: int, seed: int, turn: int) -> list[int]:
    """0 to n - 1 in the order of SHA-256 of seed, turn and number."""
    return sorted(range(n), key=lambda i: hashlib.sha256(f"{seed}:{turn}:{i}".encode()).hexdigest())


def boundaries(names: tuple[str, ...] = tuple(LIMITS), at: int = 3) -> Iterator[tuple[str, int, bool]]:
    """Of each limit, lowered to ``at``: an amount below, at and above it, and whether it passes."""
    for name in names:
        yield from ((name, at + d, d <= 0) for d in (-1, 0, 1))
