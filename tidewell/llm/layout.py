"""Reading order of scanned pages from the boxes of their lines.

A page's lines come in scanner order: down one column, down several in turn, straight across several (columns line by
line), or with the columns side by side inside one line, a gap of blanks between. ``flow`` gives the pieces of text in
the order in which a reader takes them, each with its place in the stored text, and marks adverts, which are set
in from the edge of their column.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np

#: Pixels: lines further apart at their left edge are in different columns; adverts are set in by at least INDENT.
COLUMN_STEP = 60
INDENT = 8
_GAP = re.compile(r"(?<=\S) {3,}(?=\S)|^ {3,}(?=\S)")
Piece = tuple[int, int, bool]


def _side_by_side(text: str, lines: list[str], at: list[int]) -> list[Piece] | None:
    """Pieces of a page whose lines hold several columns with gaps between; None if it is not such a page."""
    cuts = [[m.end() for m in _GAP.finditer(x)] if "   " in x else [] for x in lines]
    starts = [c for cut in cuts for c in cut]
    if len(starts) * 4 < sum(1 for x in lines if x.strip()):
        return None
    edges, values = [], np.sort(np.array(starts))
    for group in np.split(values, np.flatnonzero(np.diff(values) > 4) + 1):
        if len(group) >= max(3, len(starts) // 10):
            edges.append(int(np.median(group)) - 3)
    if not edges:
        return None
    out: list[list[Piece]] = [[] for _ in range(len(edges) + 1)]
    for x, a, cut in zip(lines, at, cuts, strict=True):
        places = [0, *[c for c in cut if any(abs(c - e - 3) <= 6 for e in edges)], len(x)]
        for s, e in zip(places, places[1:], strict=False):
            if x[s:e].strip():
                out[bisect_right(edges, s)].append((a + s, a + s + len(x[s:e].rstrip()), False))
    return [p for column in out for p in column]


def flow(text: str, x0: np.ndarray | None, y0: np.ndarray | None) -> list[Piece]:
    """Pieces (start, end, is_advert) of ``text`` in reading order; blank pieces are left out.

    Without boxes, or where their number differs from that of the lines, the stored order is taken.
    """
    lines = text.split("\n")
    at, pos = [], 0
    for x in lines:
        at.append(pos)
        pos += len(x) + 1
    if x0 is None or len(x0) != len(lines):
        return _side_by_side(text, lines, at) or [(a, a + len(x), False) for x, a in zip(lines, at, strict=True) if x.strip()]
    if "   " in text and (pieces := _side_by_side(text, lines, at)):
        return pieces
    order = np.argsort(x0, kind="stable")
    sorted_x = x0[order]
    column = np.zeros(len(lines), dtype=np.int64)
    column[order] = np.concatenate(([0], np.cumsum(np.diff(sorted_x) > COLUMN_STEP)))
    first = np.searchsorted(column[order], np.arange(int(column.max()) + 2))
    left = sorted_x[first[:-1] + (np.diff(first) - 1) // 4]
    advert = x0 - left[column] >= INDENT
    return [(at[i], at[i] + len(lines[i]), bool(advert[i])) for i in np.lexsort((y0, column)) if lines[i].strip()]


def boxes(column) -> list[tuple[np.ndarray, np.ndarray] | tuple[None, None]]:
    """(x0, y0) of every row of an Arrow column of line boxes."""
    if column.null_count == len(column):
        return [(None, None)] * len(column)
    flat = column.flatten()
    x, y = (flat.field(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("x0", "y0"))
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    return [(x[e - n : e], y[e - n : e]) if n else (None, None) for e, n in zip(ends, sizes, strict=True)]
