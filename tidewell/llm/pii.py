"""Personal information in scanned text: places and typed placeholders.

A page is put in reading order (so that a value broken over a column's lines is in one piece), every character is
scored by the candidate search, and the stretches it leaves are read by a bidirectional LSTM with CRF decoding. Long
stretches are read in overlapping windows; each character keeps the emissions of the window in which it lies further from
an end, and one Viterbi pass over the whole stretch decides, so no value is cut at a window's edge.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm import gate, tagger
from tidewell.llm.layout import boxes, flow
from tidewell.llm.pii_labels import KINDS, language

WINDOW = 160
OVERLAP = 48
#: Windows and stretches that advance side by side.
SIDE = 128
#: Emission margin to "outside" of characters that are outside for certain, and how many of them in a row part two values.
NEAR = -8.0
RUN = 8
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")
Span = tuple[str, list[tuple[int, int]]]


@lru_cache(maxsize=2)
def load(path: str) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        w = {k: f[k].astype(np.float32) if f[k].dtype == np.float16 else f[k] for k in f.files}
    w["trans"] = w["t"] + tagger.forbidden()
    return tagger.doubled(w)


def in_order(text: str, x0, y0) -> tuple[str, np.ndarray, np.ndarray]:
    """The page in reading order, adverts last; starts of its pieces there and in the stored text."""
    parts = flow(text, x0, y0)
    parts = [p for p in parts if not p[2]] + [p for p in parts if p[2]]
    here = np.cumsum([0, *[e - s + 1 for s, e, _ in parts]])[:-1] if parts else np.zeros(0, dtype=np.int64)
    return "\n".join(text[s:e] for s, e, _ in parts), here, np.array([s for s, _, _ in parts], dtype=np.int64)


def _windows(n: int) -> list[tuple[int, int]]:
    """Windows of equal length, WINDOW at most, of which neighbours share OVERLAP characters."""
    if n <= WINDOW:
        return [(0, n)]
    many = -(-(n - OVERLAP) // (WINDOW - OVERLAP))
    size = -(-(n + OVERLAP * (many - 1)) // many)
    return [(min(i * (size - OVERLAP), n - size), min(i * (size - OVERLAP), n - size) + size) for i in range(many)]


def tag_stretches(pieces: list[np.ndarray], w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Tags of every stretch of classes."""
    ends = np.cumsum([len(c) for c in pieces]).astype(np.int64)
    starts = ends - np.array([len(c) for c in pieces], dtype=np.int64)
    total = int(ends[-1]) if len(pieces) else 0
    jobs = [(k, a, z) for k, c in enumerate(pieces) for a, z in _windows_of(len(c))]
    scores, lead = np.empty((total, tagger.K), dtype=np.float32), np.empty(total, dtype=np.float32)
    jobs.sort(key=lambda j: j[2] - j[1])
    for i in range(0, len(jobs), SIDE):
        some = jobs[i : i + SIDE]
        x = np.full((max(z - a for _, a, z in some), len(some)), 10, dtype=np.int64)
        for b, (k, a, z) in enumerate(some):
            x[: z - a, b] = pieces[k][a:z]
        e = tagger.emissions(x, w)
        # by how much the best other tag leads before "outside"
        best = e[:, :, 1].copy()
        for tag in range(2, tagger.K):
            np.maximum(best, e[:, :, tag], out=best)
        best -= e[:, :, 0]
        for b, (k, a, z) in enumerate(some):
            n = len(pieces[k])
            # in an overlap each character belongs to the window whose end is further away
            before = 0 if a == 0 else (max(p for q, p in _windows_of(n) if q < a) - a) // 2
            after = z - a if z == n else z - a - (z - min(q for q, _ in _windows_of(n) if q > a)) // 2
            at = slice(starts[k] + a + before, starts[k] + a + after)
            scores[at], lead[at] = e[before:after, b], best[before:after, b]
    tags = np.zeros(total, dtype=np.int8)
    parts = _doubtful(lead, starts, ends)
    at = 0
    while at < len(parts):
        # similar lengths together, and not too many long ones
        longest = parts[min(at + SIDE, len(parts)) - 1]
        some = parts[at : at + max(1, min(SIDE, SIDE * 400 // max(int(longest[1] - longest[0]), 1)))]
        at += len(some)
        n = some[:, 1] - some[:, 0]
        e = np.zeros((int(n.max()), len(some), tagger.K), dtype=np.float32)
        for b, (a, z) in enumerate(some.tolist()):
            e[: z - a, b] = scores[a:z]
        got = tagger.viterbi(e, n, w["trans"])
        for b, (a, z) in enumerate(some.tolist()):
            tags[a:z] = got[: z - a, b]
    return [tags[a:z] for a, z in zip(starts, ends, strict=True)]


def _doubtful(lead: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Parts (from, to) of the stretches to be decoded, the shortest first: those between runs of ``RUN`` characters at each of
    which "outside" leads by more than -NEAR.

    To lead on through such a run a value would have to lose RUN x -NEAR at least, more than two new beginnings cost.
    """
    near = np.flatnonzero(lead > NEAR)
    if not len(near):
        return np.zeros((0, 2), dtype=np.int64)
    of = np.searchsorted(ends, near, "right")
    cut = np.flatnonzero((np.diff(near) > RUN) | (np.diff(of) > 0))
    first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(near) - 1]))
    parts = np.stack((np.maximum(near[first] - 1, starts[of[first]]), np.minimum(near[last] + 2, ends[of[first]])), axis=1)
    return parts[np.argsort(parts[:, 1] - parts[:, 0], kind="stable")]


@lru_cache(maxsize=4096)
def _windows_of(n: int) -> tuple[tuple[int, int], ...]:
    return tuple(_windows(n))


#: What a value must hold at least (letters that scanners put for digits count as digits).
_DIGITS = np.zeros(tagger.VOCAB, dtype=bool)
_DIGITS[[ord(c) for c in "0123456789OoQIlZzSsBbGgq|"]] = True
_LEAST = {"phone": 6, "id_number": 5, "address": 1}


#: What stands before a name or an address but is no part of it.
_LEAD = {
    "person": re.compile(r"(?:(?:Mr|Mrs|Miss|Ms|Dr|Ald|Rev|Capt|Prof|Herrn?|Frau|Fräulein|Pfarrer|Mme|Mlle|Madame|Monsieur)\b\.?[\s,]+)+", re.I),
    "email": re.compile(r"(?:e-?mail|courriel|mail an|mail|write to|écrire à)[\s:.]+(?=\S)", re.I),
}


#: A title in French, an initial elsewhere.
_MONSIEUR = re.compile(r"M\.?\s+")


def spans(texts: list[str | None], layout: list, w: dict[str, np.ndarray]) -> list[list[Span]]:
    """Per page: (kind, ranges in the stored text) of each value, in order of its first character."""
    kept: list[tuple[int, int, np.ndarray]] = []
    order: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    read_of: dict[int, str] = {}
    for d, (text, (x0, y0)) in enumerate(zip(texts, layout, strict=True)):
        if not text:
            continue
        read, here, there = in_order(text, x0, y0)
        if not read:
            continue
        order[d] = (here, there)
        read_of[d] = read
        c = tagger.codes(read)
        kept += [(d, a, c[a:z]) for a, z in gate.stretches(c, w["gate"], float(w["threshold"]))]
    out: list[list[Span]] = [[] for _ in texts]
    for (d, a, c), tags in zip(kept, tag_stretches([k[2] for k in kept], w), strict=True):
        heads = np.flatnonzero((tags > 0) & (tags % 2 == 1))
        if not len(heads):
            continue
        here, there = order[d]
        for s in heads:
            kind = KINDS[(int(tags[s]) - 1) // 2]
            e = int(s) + 1
            while e < len(tags) and tags[e] == tags[s] + 1:
                e += 1
            if kind in _LEAD and (m := _LEAD[kind].match(read_of[d], a + s, a + e)):
                s = s + m.end() - m.start()
            if kind == "person" and (m := _MONSIEUR.match(read_of[d], a + s, a + e)) and language(read_of[d]) == "fr":
                s = s + m.end() - m.start()
            if _DIGITS[c[s:e]].sum() < _LEAST.get(kind, 0) or e - s < 3:
                continue
            first, last = np.searchsorted(here, a + s, "right") - 1, np.searchsorted(here, a + e - 1, "right") - 1
            ranges = []
            for p in range(int(first), int(last) + 1):
                lo = max(int(a + s), int(here[p]))
                hi = min(int(a + e), int(here[p + 1]) - 1 if p + 1 < len(here) else int(a + e))
                if hi > lo:
                    ranges.append((int(there[p]) + lo - int(here[p]), int(there[p]) + hi - int(here[p])))
            if ranges:
                out[d].append((kind, ranges))
    for o in out:
        o.sort(key=lambda x: x[1][0][0])
    return out


def redacted(text: str, found: list[Span]) -> str:
    """``text`` with a typed placeholder for the first part of every value; further parts (on later lines) are dropped."""
    edits = sorted((a, z, f"[{kind.upper()}]" if i == 0 else "") for kind, ranges in found for i, (a, z) in enumerate(ranges))
    out, at = [], 0
    for a, z, put in edits:
        if a >= at:
            out += [text[at:a], put]
            at = z
    return "".join([*out, text[at:]])


def _batches(batches: Iterator[pa.RecordBatch], weights: str) -> Iterator[tuple[list, list, list]]:
    """(doc ids, texts, spans) of some hundred pages at a time, so that memory does not follow the batch size."""
    w = load(weights)
    for b in batches:
        for i in range(0, b.num_rows, 512):
            part = b.slice(i, 512)
            texts = part.column(1).to_pylist()
            yield part.column(0).to_pylist(), texts, spans(texts, boxes(part.column(2)), w)


def find_personal(documents: DataFrame, weights: str = WEIGHTS) -> DataFrame:
    """(doc_id, kind, start_at) of every value; start_at counts code points of the stored text from 0.

    ``kind`` is email, phone, id_number, address or person. NULL and empty texts give no rows; pages without
    usable boxes are read in stored order; extra columns are ignored; repeated pages give their rows each.
    ``weights`` is the file written by ``pii_training``.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, found in _batches(batches, weights):
            rows = [(d, kind, ranges[0][0]) for d, f in zip(ids, found, strict=True) for kind, ranges in f]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["doc_id", "kind", "start_at"])

    return documents.select("doc_id", "text", "lines").mapInArrow(go, "doc_id bigint, kind string, start_at bigint")


def redact(documents: DataFrame, weights: str = WEIGHTS) -> DataFrame:
    """(doc_id, text, n_found): texts with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [PERSON] for the values found."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, found in _batches(batches, weights):
            new = [redacted(t, f) if t else t for t, f in zip(texts, found, strict=True)]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(new, pa.string()), pa.array([len(f) for f in found], pa.int64())], names=["doc_id", "text", "n_found"])

    return documents.select("doc_id", "text", "lines").mapInArrow(go, "doc_id bigint, text string, n_found bigint")
