"""Spans of identifiers and secrets in texts, as code points. Long texts are worked on in pieces of PIECE bytes."""

from __future__ import annotations

import hashlib

import numpy as np

PIECE = 1 << 20


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rows_with(marked: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row of a block, whether a byte stands in it that ``marked`` (by byte value) marks."""
    out = np.zeros(len(offsets) - 1, bool)
    for low in range(0, len(data), PIECE):
        at = np.flatnonzero(marked[data[low : low + PIECE]]) + low
        out[np.unique(np.searchsorted(offsets, at, side="right") - 1)] = True
    return out


def runs(marked: np.ndarray, data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the longest runs of bytes that ``marked`` marks inside rows, if ``least`` long or longer."""
    starts, ends, open_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], -1
    for low in range(0, len(data), PIECE):
        inside = marked[data[low : low + PIECE]]
        before = np.r_[open_ >= 0, inside[:-1]]
        edge = np.zeros(len(inside), bool)
        edge[offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, low + len(inside))] - low] = True
        start = np.r_[[open_] if open_ >= 0 else [], np.flatnonzero(inside & (~before | edge)) + low].astype(np.int64)
        end = np.flatnonzero(before & (~inside | edge)) + low
        open_ = int(start[-1]) if inside[-1] else -1
        start = start[: len(end)]
        long = end - start >= least
        starts.append(start[long])
        ends.append(end[long])
    if open_ >= 0 and len(data) - open_ >= least:
        starts.append(np.array([open_]))
        ends.append(np.array([len(data)]))
    return np.concatenate(starts), np.concatenate(ends)


def code_points(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The number of characters before each of the ascending byte places of a text."""
    out, before = np.zeros(len(places), np.int64), 0
    for low in range(0, len(data) + 1, PIECE):
        a, b = np.searchsorted(places, [low, low + PIECE])
        inner = np.r_[0, np.cumsum((data[low : low + PIECE] & 0xC0) != 0x80)]
        out[a:b] = before + inner[places[a:b] - low]
        before += int(inner[-1])
    return out
