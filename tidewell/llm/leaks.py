"""Held-out passages inside corpus pages, by spaced-seed hashing of words.

Words are hashed after a fold that maps letters which scanners confuse to one class. Fixed masks pick some of a few
successive words and ignore the others, so a seed survives an exchanged word under an ignored position. Seeds of the test
items and of the pages are joined by hash; where enough of them agree, the page is aligned with the item word by word
(tolerant of misread letters, missing and exchanged words), and a pair is reported if the alignment holds enough successive words.

Items of equal words are one entry. Which seeds an entry keeps is decided once, over all entries: those with a word that few
entries hold, and wherever any two lost words of a passage would leave fewer than ``LEAST_SEEDS`` of those, all seeds of the
passage, however common they are. So passages shared by any number of items are found, and under all their ids.

The entries with their seeds are written to the shared folder in blocks bounded by bytes. Pages are read, ordered and hashed
once; a worker then goes through the blocks with a batch of pages. Nothing of the corpus is shuffled, no item is sent through the
driver, and a block is all that a worker holds of the items. The ids come back by a join on the pairs found.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.layout import boxes, flow
from tidewell.runtime import join_small, scratch_path, stored

#: Bytes of words and seeds in a block of items.
BLOCK_BYTES = 64 * 2**20
MIN_WORDS = 15
#: Of the words of a passage one in so many may be missing or exchanged.
ONE_IN = 6
MASKS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 3, 4), (0, 2, 4))
#: A word is rare if at most so many entries hold it, or one in RARE_SHARE of all if that is more. Words that are not rare are at
#: most RARE_SHARE times the mean number of words of an item, so their list is bounded.
RARE_ENTRIES = 12
RARE_SHARE = 1_000
#: Seeds that a passage of MIN_WORDS keeps when any two of its words are lost, and that must agree before a page is aligned.
LEAST_SEEDS = 3
_MOST_COVERING = sum(m[-1] + 1 for m in MASKS)
#: Words of the page that may lie between two words of a passage (an advert that could not be told by its box).
MAX_BETWEEN = 40
#: Letters that scanners take for one another; accents are dropped.
CLASSES = ("rnuvyüûùúñ", "eécèêëoóôöàâäáac0s5dç8", "tlfi1jîïíì|!", "hkb6", "g9q", "wm")
_FOLD = {ord(c): k[0] for k in CLASSES for c in k} | {ord(c.upper()): k[0] for k in CLASSES for c in k if c.upper() != c and len(c.upper()) == 1}
_FOLD |= {ord(c): c.lower() for c in "PXZ"} | {ord("ß"): "b", ord("æ"): "e", ord("œ"): "e"}
#: Punctuation among the classes is a letter only next to one; alone it would make words out of marks.
_FOLD = {k: v for k, v in _FOLD.items() if chr(k) not in "|!"}
_WORD = re.compile(r"[^\W_]+")
_BREAK = "-‐‑¬­–"


def fold(text: str) -> str:
    """Confusable letters to one letter per class; as long as the text."""
    return text.translate(_FOLD)


def close(a: str, b: str) -> bool:
    """Whether two folded words are one word misread: one edit from 5 letters on, two from 12 on."""
    n = min(len(a), len(b))
    most = 0 if n < 5 else 1 if n < 12 else 2
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    # what both begin and end with costs no edit
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if len(a) <= 1 and len(b) <= 1:
        return most >= 1
    if most < 2:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        least = i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
            least = min(least, row[j])
        if least > most:
            return False
    return row[-1] <= most


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def placed(words: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, places and mask numbers of all seeds over word hashes; seeds with a picked word that is not ``known`` are left out."""
    hashes, places, masks = [], [], []
    for n, mask in enumerate(MASKS):
        m = len(words) - mask[-1]
        if m <= 0:
            continue
        at = np.arange(m) if known is None else np.flatnonzero(np.logical_and.reduce([known[o : o + m] for o in mask]))
        h = np.full(len(at), n + 1, dtype=np.uint64)
        for o in mask:
            h = (h ^ words[at + o]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        hashes.append(h)
        places.append(at)
        masks.append(np.full(len(at), n))
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(places), np.concatenate(masks)


def kept_seeds(words: list[str], common: set[str] | frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the seeds that an entry keeps: those with a word that is not ``common``, and what passages need beside them."""
    h, at, mask = placed(np.array([word_hash(w) for w in words], dtype=np.uint64))
    rare = np.array([w not in common for w in words])
    keep = rare[at[:, None] + np.array(MASKS)[mask]].any(axis=1)
    keep |= _needed(len(words), at, mask, keep)
    return h[keep], at[keep]


def _needed(m: int, at: np.ndarray, mask: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Which seeds of an entry of m words lie in a passage that two lost words may leave with too few kept seeds."""
    last = at + np.array([x[-1] for x in MASKS])[mask]
    out = np.zeros(len(at), dtype=bool)
    words = np.arange(m)
    cover = ((at[:, None] <= words) & (words <= last[:, None])).astype(np.float32)
    for w in range(m - MIN_WORDS + 1):
        inside = (at >= w) & (last < w + MIN_WORDS)
        c = cover[inside & kept, w : w + MIN_WORDS]
        if len(c) - 2 * _MOST_COVERING >= LEAST_SEEDS:
            continue
        both = c.T @ c
        d = np.diagonal(both)
        if (len(c) - d[:, None] - d + both).min() < LEAST_SEEDS:
            out |= inside
    return out


class Block:
    """Entries of one block with their words and kept seeds."""

    def __init__(self, entries: list[int], words: list[list[str]], hashes: list[np.ndarray], places: list[np.ndarray]):
        self.entries = entries
        self.number: dict[str, int] = {}
        self.items = [np.array([self.number.setdefault(w, len(self.number)) for w in ws], dtype=np.int64) for ws in words]
        self.words = list(self.number)
        sizes = [len(h) for h in hashes]
        h = np.concatenate([np.zeros(0, dtype=np.uint64), *hashes])
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.entry = np.repeat(np.arange(len(entries)), sizes)[order]
        self.at = np.concatenate([np.zeros(0, dtype=np.int64), *places])[order]
        self.near = lru_cache(maxsize=200_000)(self._near)
        self.by_part: dict[tuple[int, int, str], list[int]] = defaultdict(list)
        for i, w in enumerate(self.words):
            for n, part in enumerate((w[:2], w[-3:], w[3:6])):
                self.by_part[len(w), n, part].append(i)

    def _near(self, word: str) -> tuple[int, ...]:
        """Words of the entries that a page word may be; words of the same first letters or last letters are compared."""
        exact = self.number.get(word)
        if exact is not None:
            return (exact,)
        if len(word) < 5:
            return ()
        words = self.words
        span = 1 if len(word) < 12 else 2
        parts = enumerate((word[:2], word[-3:], word[3:6]))
        like = {i for k, part in parts for n in range(len(word) - span, len(word) + span + 1) for i in self.by_part.get((n, k, part), ())}
        return tuple(i for i in sorted(like, key=lambda i: (len(words[i]), i)) if close(words[i], word))

    def stretches(self, seeds: np.ndarray, places: np.ndarray, n: int) -> dict[int, list[tuple[int, int]]]:
        """Per entry the stretches of a page of n words in which enough of its seeds agree on where it lies."""
        i, j = np.searchsorted(self.hashes, seeds, "left"), np.searchsorted(self.hashes, seeds, "right")
        hit = np.flatnonzero(i < j)
        if len(hit) < LEAST_SEEDS:
            return {}
        many = (j - i)[hit]
        of = np.repeat(hit, many)
        which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + i[of]
        entry, lies = self.entry[which], places[of] - self.at[which]
        order = np.lexsort((lies, entry))
        entry, lies = entry[order], lies[order]
        # seeds of an entry agree if its beginnings, as they say it, lie within a few adverts' words of each other
        new = np.concatenate(([True], (np.diff(entry) != 0) | (np.diff(lies) > MAX_BETWEEN)))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(entry)) - 1
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for a, z in zip(first[last - first + 1 >= LEAST_SEEDS].tolist(), last[last - first + 1 >= LEAST_SEEDS].tolist(), strict=True):
            k = int(entry[a])
            start, end = max(0, int(lies[a]) - 2 * MAX_BETWEEN), min(n, int(lies[z]) + len(self.items[k]) + 2 * MAX_BETWEEN)
            if out[k] and start <= out[k][-1][1]:
                out[k][-1] = (out[k][-1][0], max(end, out[k][-1][1]))
            else:
                out[k].append((start, end))
        return out

    def leaks(self, words: list[str], seeds: np.ndarray, places: np.ndarray) -> list[int]:
        """The entries that a page (its words and seeds) holds."""
        stretches = self.stretches(seeds, places, len(words))
        if not stretches:
            return []
        covered = np.zeros(len(words), dtype=bool)
        for a, z in {x for s in stretches.values() for x in s}:
            covered[a:z] = True
        # only now are misread words looked up
        ways = [self.near(w) if c else () for w, c in zip(words, covered.tolist(), strict=True)]
        first = np.concatenate(([0], np.cumsum([len(w) for w in ways])))
        at = np.repeat(np.arange(len(words)), np.diff(first))
        way = np.fromiter((i for w in ways for i in w), dtype=np.int64, count=first[-1])
        present = np.zeros(len(self.words), dtype=bool)
        out = []
        for k in sorted(stretches):
            item = self.items[k]
            for a, z in stretches[k]:
                here = slice(first[a], first[z])
                present[way[here]] = True
                matched = present[item]
                present[way[here]] = False
                # the alignment matches no other words than these, so nothing is lost where they do not suffice
                if np.count_nonzero(matched) * ONE_IN < MIN_WORDS * (ONE_IN - 1) or _longest(matched) < MIN_WORDS:
                    continue
                flags = np.zeros((z - a, len(item)), dtype=bool)
                np.logical_or.at(flags, at[here] - a, way[here, None] == item)
                if any(_longest(piece) >= MIN_WORDS for piece in align(flags)):
                    out.append(self.entries[k])
                    break
        return out


class Vocabulary:
    """Hashes of all words of all entries."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.of = lru_cache(maxsize=200_000)(word_hash)

    def __contains__(self, word: str) -> bool:
        return bool(self.known(np.array([self.of(word)], dtype=np.uint64))[0])

    def known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes

    def hashed(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.of, words), dtype=np.uint64, count=len(words))


def page_words(text: str, x0, y0, known: Vocabulary | set[str]) -> list[str]:
    """Folded words of a page in reading order without adverts; words broken at line ends are put together.

    A break without a mark is mended where only the whole is a word of the items.
    """
    folded = fold(text)
    words: list[str] = []
    joined = False
    for start, end, advert in flow(text, x0, y0):
        if advert:
            continue
        line = _WORD.findall(folded, start, end)
        if not line:
            continue
        if words and joined:
            words[-1] += line[0]
            line = line[1:]
        elif words and (whole := words[-1] + line[0]) in known and not (words[-1] in known and line[0] in known):
            words[-1] = whole
            line = line[1:]
        words += line
        joined = text[end - 1] in _BREAK
    return words


@lru_cache(maxsize=1000)
def _stretches(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of all stretches of at least MIN_WORDS of n words."""
    return np.triu_indices(n + 1, MIN_WORDS)


def _longest(matched: np.ndarray) -> int:
    """Length of the longest stretch of successive item words of which at most one in ONE_IN is unmatched."""
    n = len(matched)
    c = np.concatenate(([0], np.cumsum(matched)))
    i, j = _stretches(n)
    ok = (c[j] - c[i]) * ONE_IN >= (ONE_IN - 1) * (j - i)
    ok &= matched[np.minimum(i, n - 1)] & matched[np.maximum(j - 1, 0)]
    return int((j - i)[ok].max()) if ok.any() else 0


def align(page: np.ndarray) -> list[np.ndarray]:
    """Which words of the item the best local alignment with the page matches, apart for its pieces.

    More than MAX_BETWEEN successive page words without a match part two pieces. ``page`` is a matrix of match flags (page word, item word). Missing or exchanged item words cost much, page words in
    between little, so a passage is followed across an advert.
    """
    n, m = page.shape
    cols = np.arange(m) * 0.6
    score = np.zeros((n + 1, m + 1))
    for p in range(n):
        s = np.maximum(score[p, 1:] - 0.03, score[p, :-1] + np.where(page[p], 1.0, -0.6))
        s = np.maximum(s, 0)
        s = np.maximum.accumulate(s + cols) - cols
        score[p + 1, 1:] = s
    pieces = [np.zeros(m, dtype=bool)]
    p, q = np.unravel_index(int(score.argmax()), score.shape)
    run = 0
    while p > 0 and q > 0 and score[p, q] > 0:
        s = score[p, q]
        if page[p - 1, q - 1] and abs(s - score[p - 1, q - 1] - 1) < 1e-9:
            pieces[-1][q - 1] = True
            p, q, run = p - 1, q - 1, 0
        elif abs(s - score[p - 1, q] + 0.03) < 1e-9:
            p, run = p - 1, run + 1
        elif abs(s - score[p, q - 1] + 0.6) < 1e-9:
            q -= 1
        else:
            p, q, run = p - 1, q - 1, 0
        if run > MAX_BETWEEN and pieces[-1].any():
            pieces.append(np.zeros(m, dtype=bool))
    return pieces


def item_words(text: str | None) -> list[str]:
    return [fold(w) for w in _WORD.findall(text or "")]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of enough words -> (entry, item_id, words); the entry is a hash of the words."""
    for b in batches:
        rows = [(i, w) for i, w in zip(b.column(0).to_pylist(), map(item_words, b.column(1).to_pylist()), strict=True) if len(w) >= MIN_WORDS]
        names = [word_hash(" ".join(w)) - 2**63 for _, w in rows]
        yield pa.record_batch([pa.array(names, pa.int64()), pa.array([i for i, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.list_(pa.string()))], names=["entry", "item_id", "words"])


def prepare(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[str, int, DataFrame]:
    """Write the index of the items to the shared folder; returns its path, the number of blocks and (entry, item_id).

    ``blocks/block=N`` holds (entry, words, hashes, places), ``words`` the hash of every word.
    """
    spark = items.sparkSession
    every = stored(items.where("text IS NOT NULL").select("item_id", "text").mapInArrow(_entries, "entry bigint, item_id bigint, words array<string>"), "items")
    entries = every.groupBy("entry").agg(F.first("words").alias("words"))  # copies hold equal words
    held = stored(entries.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    n, size = entries.agg(F.count(F.lit(1)), F.sum(F.size("words"))).first()
    common = frozenset(r.word for r in held.where(F.col("n") > max(RARE_ENTRIES, n // RARE_SHARE)).select("word").collect())  # bounded, see RARE_SHARE
    # a word is some ten bytes and begins one seed per mask of sixteen bytes
    blocks = max(1, -(-(size or 0) * (10 + 16 * len(MASKS)) // block_bytes))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [kept_seeds(w, common) for w in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([h.astype(np.int64) for h, _ in kept], pa.list_(pa.int64())), pa.array([a for _, a in kept], pa.list_(pa.int64()))], names=["entry", "words", "hashes", "places"])

    path = scratch_path(spark, "leaks")
    index = entries.mapInArrow(seeds, "entry bigint, words array<string>, hashes array<bigint>, places array<bigint>")
    index.withColumn("block", F.pmod("entry", F.lit(blocks))).write.partitionBy("block").parquet(f"{path}/blocks")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(np.array([word_hash(w) for w in b.column(0).to_pylist()], dtype=np.uint64).astype(np.int64))], names=["h"])

    held.select("word").mapInArrow(hashed, "h bigint").write.parquet(f"{path}/words")
    return path, blocks, every.select("entry", "item_id").distinct()


def _table(path: str, columns: list[str]) -> pa.Table:
    """A Parquet folder of the shared file system, read by a worker; an empty table where there is none."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if where.get_file_info(root).type == fs.FileType.NotFound:
        return pa.table({c: [] for c in columns})
    return ds.dataset(root, filesystem=where, format="parquet").to_table(columns=columns)


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(_table(f"{path}/words", ["h"])["h"].to_numpy().astype(np.int64).view(np.uint64))


@lru_cache(maxsize=1)
def _block(path: str, number: int) -> Block:
    """The block a worker works on; the one before is let go."""
    t = _table(f"{path}/blocks/block={number}", ["entry", "words", "hashes", "places"])
    lists = lambda c: [np.array(x, dtype=np.int64) for x in t[c].to_pylist()]
    return Block(t["entry"].to_pylist(), t["words"].to_pylist(), [h.view(np.uint64) for h in lists("hashes")], lists("places"))


def find_leaks(documents: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs (doc_id, item_id): the page holds at least MIN_WORDS successive words of the item in their order.

    At most one word in ONE_IN may be missing or exchanged; case, punctuation, line ends, broken words and misread letters
    do not matter. Whole texts are searched. NULL and empty texts and items of fewer than MIN_WORDS words give no
    pair; repeated rows give a pair once; extra columns are ignored; a NULL doc_id or item_id stays NULL. ``block_bytes`` bounds
    what a worker holds of the items; the result does not depend on it.
    """
    path, blocks, members = prepare(items, block_bytes)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        for batch in batches:
            pages = []
            for text, (x, y) in zip(batch.column(1).to_pylist(), boxes(batch.column(2)), strict=True):
                words = page_words(text, x, y, vocabulary) if text else []
                h = vocabulary.hashed(words)
                pages.append((words, *placed(h, vocabulary.known(h))[:2]))
            ids = batch.column(0).to_pylist()
            for b in range(blocks):
                block = _block(path, b)
                pairs = [(d, e) for d, (words, seeds, places) in zip(ids, pages, strict=True) if len(seeds) for e in block.leaks(words, seeds, places)]
                yield pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["doc_id", "entry"])

    found = documents.select("doc_id", "text", "lines").mapInArrow(go, "doc_id bigint, entry bigint")
    return join_small(found, members, "entry").select("doc_id", "item_id").distinct()
