"""Sorted spans (start, end) of one text, in passes linear in their number."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


def union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same characters, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def gaps(taken: list[tuple[int, int]], length: int) -> Iterator[tuple[int, int]]:
    """What disjoint ordered spans leave of a text."""
    at = 0
    for s, e in [*taken, (length, length)]:
        if at < s:
            yield at, s
        at = e


def apart(spans: Iterable[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Those of some ordered spans that meet none of the disjoint ordered ones."""
    i = 0
    for s, e in spans:
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if i == len(taken) or taken[i][0] >= e:
            yield s, e
