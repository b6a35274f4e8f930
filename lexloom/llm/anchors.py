"""Content-defined anchors: which windows of a fixed width share their smallest gram.

Each window of `width` symbols is assigned to the gram in it with the smallest hash, its anchor. That choice depends
on the window's content only, so equal windows have equal anchors wherever they occur. Neighbouring windows mostly
share an anchor: a region is a run of window starts a..b with one anchor, and covers the symbols a..b + width.
Equal windows are found by comparing the regions of an anchor, about one for each half gram-to-width distance.

Sequences come as hashes of the EIGHT symbols from each place on, two independent ones; a region's two content hashes
fold those of its places in steps of eight. Long sequences are worked off in stretches of STRETCH symbols; a region that
a stretch ends falls into two, which only makes it differ from copies that are cut elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from lexloom.llm.common import RunHash, joined

EIGHT = 8
_POSITION_BITS = 28
STRETCH = 1 << 20


@dataclass
class Regions:
    anchor: np.ndarray  # hash of the anchor gram
    content: np.ndarray  # hash of the covered symbols
    check: np.ndarray  # the second hash of them
    text: np.ndarray  # index of the text
    start: np.ndarray  # first window start, in the text
    more: np.ndarray  # further window starts


def eights(symbols: np.ndarray) -> np.ndarray:
    """A hash of the EIGHT symbols from each place on."""
    return RunHash(symbols, (EIGHT, EIGHT)).levels[3]


def grams_of(eight: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` (at least EIGHT) symbols from each place on."""
    h, size = eight, EIGHT
    while 2 * size <= gram:
        h, size = joined(h[:-size], h[size:]), 2 * size
    return joined(h[: len(h) - (gram - size)], h[gram - size :]) if size < gram else h


def folded(eight: np.ndarray, start: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
    """A hash of each run start..end of EIGHT to `longest` symbols."""
    h = (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for step in range(0, longest, EIGHT):
        h = joined(h, eight[np.minimum(start + step, end - EIGHT)])
    return h


def _stretch(eight: np.ndarray, check: np.ndarray, lo: int, first: np.ndarray, width: int, gram: int) -> Regions:
    n = len(eight) + EIGHT - 1
    span, n_windows, longest = width - gram + 1, n - width + 1, 2 * width - gram  # a gram lies in `span` windows
    grams = grams_of(eight, gram)
    mask = np.uint64((1 << _POSITION_BITS) - 1)
    key = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    pad = -len(key) % span
    blocks = np.append(key, np.full(pad, ~np.uint64(0))).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(behind[:n_windows], ahead[span - 1 : span - 1 + n_windows]) & mask).astype(np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(np.clip(first, lo, lo + n_windows)))
    window = np.flatnonzero(lo + np.arange(n_windows) + width <= first[text + 1])
    text, anchor = text[window], least[window]
    head = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))) if len(window) else window
    more = np.diff(np.append(head, len(window))) - 1
    at = window[head]
    content, second = (folded(x, at, at + more + width, longest) for x in (eight, check))
    return Regions(grams[anchor[head]], content, second, text[head], lo + at - first[text[head]], more)


def regions(blocks: Callable[[int, int], tuple[np.ndarray, np.ndarray]], first: np.ndarray, width: int, gram: int, stretch: int = STRETCH) -> Iterator[Regions]:
    """The regions of the texts first[i]:first[i + 1]; blocks(lo, hi) gives two independent hashes of the EIGHT symbols
    from each place on that lie in lo..hi."""
    n = int(first[-1])
    for lo in range(0, max(n - width + 1, 0), stretch):
        hi = min(lo + stretch + width - 1, n)
        if hi - lo >= width:
            yield _stretch(*blocks(lo, hi), lo, first, width, gram)
