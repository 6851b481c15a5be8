"""Trains the tagger of personal information: ``python -m tidewell.llm.pii_training OUT.npz SECONDS DOCUMENTS.parquet... --held DOCUMENTS.parquet...``.

If OUT.npz exists, training goes on from its weights.

Labelled windows come from a bounded sample of well-read pages (``MAX_PAGES``); scanner damage is put into them: misread
letters at a rate drawn per window, line breaks with and without marks, and capitals. The pages show one style of each kind of
value; so in a part of the windows values are exchanged for ones of general shapes, or a sentence with such values is put between
the lines (``pii_formats``). Texts of the files given after ``--held`` are never fitted on. Worker processes share the
weights and each works out the gradient of its own windows.
"""

from __future__ import annotations

import multiprocessing as mp
import os
import re
import sys
import time
from collections import Counter

import numpy as np
import pyarrow.dataset as ds

from tidewell.llm import gate, pii_formats, pii_labels, tagger
from tidewell.llm.layout import boxes, flow

#: Bound on the pages that the classifier is fitted on, and the share of known words that makes a page well read.
MAX_PAGES = 16_000
MAX_HELD = 2_000
WELL_READ = 0.98
WINDOW = 144
#: What scanners take letters for, the commoner first.
CONFUSIONS = {
    "r": "nnnns", "e": "ccocoof", "s": "5a58a", "a": "osos", "t": "lfl", "n": "uru", "d": "aa", "i": "1lj", "u": "nvn", "h": "kbn", "o": "ec0",
    "g": "9q", "c": "eo", "l": "i1I", "y": "v", "b": "6h", "f": "t", "w": "mv", "ä": "a", "ü": "iu", "ö": "o", "é": "ec", "è": "e", "ß": "b",
    "O": "0Q", "I": "1l", "S": "58", "B": "8R", "Z": "2", "G": "6C", "C": "G", "E": "FB", "F": "E", "R": "B", "N": "H", "H": "N", "D": "O", "T": "I",
    "0": "O", "1": "lI", "5": "S", "2": "Z", "8": "B", "6": "b", "3": "8", "9": "g", "@": "©®", ".": ",", ",": ".", "M": "N", "W": "V", "U": "V",
}
LONGER = {"d": "cl", "m": "rn", "w": "vv", "n": "ri", "h": "li", "u": "ii"}
MARKS = ("-", "-", "‐", "¬", "­", "")


def flows(path: str, most: int, without: frozenset[str] = frozenset()) -> list[str]:
    """Pages in reading order, adverts after the articles; texts of ``without`` are passed over."""
    out = []
    for b in ds.dataset(path).to_batches(columns=["text", "lines"], batch_size=2000, use_threads=False):
        for text, (x, y) in zip(b.column(0).to_pylist(), boxes(b.column(1)), strict=True):
            if text and text not in without:
                parts: tuple[list[str], list[str]] = ([], [])
                for s, e, advert in flow(text, x, y):
                    parts[advert].append(text[s:e])
                out.append("\n".join(parts[0] + parts[1]))
            if len(out) >= most:
                return out
    return out


def labelled(pages: list[str]) -> tuple[list[tuple[str, np.ndarray, np.ndarray, list]], pii_labels.Lists]:
    """(text, tags, trainable, spans) of the well-read pages."""
    seen: Counter[str] = Counter()
    plain = [re.sub(r"[-‐¬­]\n", "", p) for p in pages]
    for p in plain:
        seen.update(set(re.findall(r"\w{4,}", p)))
    common = {w for w, n in seen.items() if n >= max(3, len(pages) // 400)}

    def quality(p: str) -> float:
        words = re.findall(r"\b[a-zà-ÿ]{4,}\b", p)
        return sum(w in common for w in words) / max(1, len(words))

    clean = [p for p, q in zip(pages, plain, strict=True) if quality(q) >= WELL_READ]
    lists = pii_labels.learn_lists(clean)
    out = []
    for p in clean:
        spans, good = pii_labels.label(p, lists)
        tags = np.zeros(len(p), dtype=np.int8)
        for a, z, kind in spans:
            i = tagger.TAGS.index(f"I-{kind}")
            tags[a:z], tags[a] = i, i - 1
        out.append((p, tags, good, spans))
    return out, lists


def damage(text: str, tags: np.ndarray, rng: np.random.Generator) -> tuple[str, np.ndarray]:
    """A window as a worse scan would have it; tags follow their characters."""
    rate = rng.choice([0, 0, 0.01, 0.03, 0.06, 0.1, 0.15])
    if rng.random() < 0.06 and len(text.upper()) == len(text):
        text = text.upper()
    breaks = rng.random() < 0.5
    chars, out = [], []
    for i, ch in enumerate(text):
        t = int(tags[i])
        if rate and rng.random() < rate:
            if ch in LONGER and rng.random() < 0.15:
                two = LONGER[ch]
                chars += [two[0], two[1]]
                out += [t, t + 1 if t % 2 else t]
                continue
            if ch in CONFUSIONS:
                ch = CONFUSIONS[ch][rng.integers(len(CONFUSIONS[ch]))]
        if breaks and i and rng.random() < (0.03 if t else 0.01) and text[i - 1] != "\n" and ch != "\n":
            inside = t if t and t % 2 == 0 else 0
            if ch == " ":
                ch = "\n"
            elif ch.isalnum() and text[i - 1].isalnum():
                for m in MARKS[rng.integers(len(MARKS))] + "\n":
                    chars.append(m)
                    out.append(inside)
        elif breaks and ch == "\n" and rng.random() < 0.2 and text[i - 1] not in "-‐¬­":
            ch = " "
        chars.append(ch)
        out.append(t)
    return "".join(chars), np.array(out, dtype=np.int64)


def strayed(text: str, tags: np.ndarray, pages: list, rng: np.random.Generator) -> tuple[str, np.ndarray]:
    """A window into which, at times, a line of another page has strayed, as where reading order went wrong."""
    if rng.random() > 0.2:
        return text, tags
    ends = [i for i, ch in enumerate(text[:-1]) if ch == "\n" and not tags[i] and (not tags[i + 1] or tags[i + 1] % 2)]
    other, their, good, _ = pages[rng.integers(len(pages))]
    a = other.rfind("\n", 0, int(rng.integers(1, max(2, len(other))))) + 1
    z = other.find("\n", a)
    if not ends or z < 0 or not good[a:z].all() or (their[a] and their[a] % 2 == 0) or (z < len(other) and their[z]):
        return text, tags
    at = ends[rng.integers(len(ends))] + 1
    return text[:at] + other[a : z + 1] + text[at:], np.concatenate((tags[:at], their[a : z + 1], tags[at:]))


def general(text: str, tags: np.ndarray, rng: np.random.Generator) -> tuple[str, np.ndarray]:
    """A window with values of general shapes: in place of its own ones, or in a sentence of their own between lines."""
    how = rng.random()
    if how < 0.45:
        return text, tags
    if how < 0.72:
        parts, marks, at = [], [], 0
        for a in np.flatnonzero(tags % 2 == 1):
            z = a + 1
            while z < len(tags) and tags[z] == tags[a] + 1:
                z += 1
            kind = pii_labels.KINDS[(int(tags[a]) - 1) // 2]
            v = pii_formats.value(kind, rng)
            parts += [text[at:a], v]
            marks += [tags[at:a], np.full(len(v), tags[a] + 1)]
            marks[-1][0] = tags[a]
            at = z
        return "".join([*parts, text[at:]]), np.concatenate([*marks, tags[at:]])
    places = [i + 1 for i, ch in enumerate(text) if ch in "\n " and not tags[i] and (i + 1 == len(tags) or not tags[i + 1] or tags[i + 1] % 2)] or [0]
    at = places[rng.integers(len(places))] if not tags[0] or tags[0] % 2 else 0
    said, spans = pii_formats.sentence(rng, pii_labels.KINDS)
    new = np.zeros(len(said) + 1, dtype=np.int64)
    for a, z, kind in spans:
        i = tagger.TAGS.index(f"I-{kind}")
        new[a:z], new[a] = i, i - 1
    return text[:at] + said + " " + text[at:], np.concatenate((tags[:at], new, tags[at:]))


def batch(pages: list, size: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """``size`` damaged windows, half of them around a span."""
    xs, ys = [], []
    while len(xs) < size:
        text, tags, good, spans = pages[rng.integers(len(pages))]
        if spans and rng.random() < 0.6:
            a, z, _ = spans[rng.integers(len(spans))]
            at = int((a + z) / 2 - rng.integers(15, WINDOW))
        else:
            at = int(rng.integers(-10, max(1, len(text) - WINDOW // 2)))
        at = max(0, at)
        end = min(len(text), at + WINDOW + 20)
        if end - at < 20 or not good[at:end].all() or (tags[at] and tags[at] % 2 == 0):
            continue
        t, y = damage(*general(*strayed(text[at:end], tags[at:end], pages, rng), rng), rng)
        # a longer window is cut at random, not always at its end
        skip = int(rng.integers(0, max(1, len(t) - WINDOW + 1)))
        if y[skip] and y[skip] % 2 == 0:
            skip = 0
        x = tagger.codes(t)[skip : skip + WINDOW]
        y = y[skip : skip + len(x)]
        if len(x) < WINDOW:
            x, y = np.pad(x, (0, WINDOW - len(x)), constant_values=10), np.pad(y, (0, WINDOW - len(y)))
        xs.append(x)
        ys.append(y)
    return np.array(xs).T, np.array(ys).T


def _worker(k, pages, names, shapes, weights, grads, losses, start, done, size):
    rng = np.random.default_rng(1000 + k)
    w, g = _views(np.frombuffer(weights, dtype=np.float32), names, shapes), np.frombuffer(grads, dtype=np.float32)
    while True:
        x, y = batch(pages, size, rng)
        start.wait()
        if losses[-1] < 0:
            return
        loss, grad = tagger.loss_and_gradient(x, y, w)
        g[:] = np.concatenate([grad[n].ravel() for n in names])
        losses[k] = loss
        done.wait()


def _views(flat: np.ndarray, names: list[str], shapes: list[tuple]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n, s in zip(names, shapes, strict=True):
        size = int(np.prod(s))
        out[n] = flat[at : at + size].reshape(s)
        at += size
    return out


def train(pages: list, seconds: float, workers: int = 8, size: int = 40, seed: int = 0, rate: float = 5e-3, hidden: int = tagger.HIDDEN, start_from: dict | None = None) -> dict[str, np.ndarray]:
    """Adam with a cosine schedule over ``seconds``."""
    first = start_from or tagger.new_weights(seed, hidden)
    names, shapes = list(first), [v.shape for v in first.values()]
    total = sum(v.size for v in first.values())
    ctx = mp.get_context("fork")
    weights = ctx.RawArray("f", total)
    grads = [ctx.RawArray("f", total) for _ in range(workers)]
    losses = ctx.RawArray("d", workers + 1)
    flat = np.frombuffer(weights, dtype=np.float32)
    flat[:] = np.concatenate([v.ravel() for v in first.values()])
    start, done = ctx.Barrier(workers + 1), ctx.Barrier(workers + 1)
    team = [ctx.Process(target=_worker, args=(k, pages, names, shapes, weights, grads[k], losses, start, done, size), daemon=True) for k in range(workers)]
    for p in team:
        p.start()
    views = [np.frombuffer(g, dtype=np.float32) for g in grads]
    m, v, mean = np.zeros(total, dtype=np.float32), np.zeros(total, dtype=np.float32), np.zeros(total, dtype=np.float64)
    began, step, averaged, smooth = time.time(), 0, 0, None
    while (spent := (time.time() - began) / seconds) < 1:
        start.wait()
        done.wait()
        step += 1
        g = sum(views) / workers
        norm = float(np.sqrt((g * g).sum()))
        if norm > 1:
            g = g / norm
        m += 0.1 * (g - m)
        v += 0.002 * (g * g - v)
        lr = rate * min(1, step / 100) * (0.02 + 0.98 * (1 + np.cos(np.pi * spent)) / 2)
        flat -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-8)).astype(np.float32)
        if spent > 0.9:
            mean += flat
            averaged += 1
        loss = float(np.mean(losses[:workers]))
        smooth = loss if smooth is None else 0.98 * smooth + 0.02 * loss
        if step % 100 == 0:
            print(f"step {step}, {time.time() - began:.0f} s, loss {smooth:.5f}", flush=True)
    losses[workers] = -1
    start.wait()
    if averaged:
        flat[:] = (mean / averaged).astype(np.float32)
    return {k: x.copy() for k, x in _views(flat, names, shapes).items()}


def fit_gate(pages: list, held: list, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights of the candidate search, and the score above which 99.95 % of the held-out spans, damaged and of general shapes, lie."""
    rng = np.random.default_rng(seed)
    def worn(ps: list) -> list:
        """Damaged pages, and pages with general values in their stead."""
        out = [damage(p[0], p[1], rng) for p in ps]
        for p in ps:
            a = 0
            while a < len(p[0]):
                z = min(len(p[0]), a + 2 * WINDOW)
                while z < len(p[0]) and p[1][z] and p[1][z] % 2 == 0:
                    z += 1
                out.append(damage(*general(p[0][a:z], p[1][a:z], rng), rng))
                a = z
        # windows stand 16 line ends apart in long rows: each row costs a whole table of counts
        apart = np.full(16, 10)
        rows = [out[i : i + 2000] for i in range(0, len(out), 2000)]
        return [(np.concatenate([x for t, _ in r for x in (tagger.codes(t), apart)]).astype(np.int64), np.concatenate([x for _, y in r for x in (y, np.zeros(16))]).astype(np.int64)) for r in rows]

    weights = gate.fit(worn(pages))
    least = []
    for c, y in worn(held):
        s = gate.scores(c, weights)
        for a in np.flatnonzero(y % 2 == 1):
            z = a + 1
            while z < len(y) and y[z] == y[a] + 1:
                z += 1
            least.append(s[max(0, a - gate.WINDOW + 2) : z].max())
    return weights, float(np.quantile(least, 0.0005))


def starts(texts: list[str], w: dict) -> list[set[tuple[str, int]]]:
    """What the operator finds in texts in reading order."""
    from tidewell.llm.pii import spans

    return [{(k, r[0][0]) for k, r in found} for found in spans(texts, [(None, None)] * len(texts), w)]


def report(name: str, got: list[set], want: list[set]) -> None:
    for k in pii_labels.KINDS:
        g, t = [{x for x in s if x[0] == k} for s in got], [{x for x in s if x[0] == k} for s in want]
        hit, found, there = (sum(len(x) for x in y) for y in ([a & b for a, b in zip(g, t, strict=True)], g, t))
        print(f"{name}, {k}: there {there}, precision {hit / max(found, 1):.4f}, recall {hit / max(there, 1):.4f}", flush=True)


def evaluate(weights: dict[str, np.ndarray], held: list, seed: int = 7) -> None:
    """Held-out pages as they are and with general values, by the whole operator; and what the candidate search loses."""
    rng = np.random.default_rng(seed)
    for name in ("held-out pages", "general values"):
        texts, want = [], []
        for text, tags, good, spans_ in held:
            if name == "general values":
                text, tags = general(text[: 4 * WINDOW], tags[: 4 * WINDOW].astype(np.int64), rng)
            elif not good.all():
                continue
            texts.append(text)
            want.append({(pii_labels.KINDS[(int(tags[i]) - 1) // 2], int(i)) for i in np.flatnonzero(tags % 2 == 1)})
        report(name, starts(texts, weights), want)
        report(name + ", every character read", starts(texts, weights | {"threshold": np.float32(-99)}), want)


def main(args: list[str]) -> None:
    out, seconds, *paths = args
    paths, keep = (paths[: paths.index("--held")], paths[paths.index("--held") + 1 :]) if "--held" in paths else (paths, [])
    apart = frozenset(t for p in keep for t in ds.dataset(p).to_table(columns=["text"])["text"].to_pylist() if t)
    fit = [p for path in paths for p in labelled(flows(path, MAX_PAGES // len(paths), apart))[0]]
    held = [p for path in keep for p in labelled(flows(path, MAX_HELD))[0]] or fit[::20]
    print(len(fit), "pages to fit,", len(held), "held out", Counter(k for p in fit for *_, k in p[3]), flush=True)
    weights, threshold = fit_gate(fit, held)
    share = [sum(z - a for a, z in gate.stretches(tagger.codes(p[0]), weights, threshold)) for p in held]
    print(f"gate {threshold:.3f}: {sum(share) / sum(len(p[0]) for p in held):.3f} of the text is read", flush=True)
    before = None
    if os.path.exists(out):
        with np.load(out) as f:
            before = {k: f[k].astype(np.float32) for k in tagger.new_weights(0)}
    w = train(fit, float(seconds), start_from=before, rate=3e-3 if before else 5e-3) if float(seconds) > 0 else before
    np.savez_compressed(out, gate=weights, threshold=np.float32(threshold), **{k: v.astype(np.float16) for k, v in w.items()})
    from tidewell.llm.pii import load

    evaluate(load(out), held[:400])


if __name__ == "__main__":
    main(sys.argv[1:])
