"""Labelled spans for training the tagger of personal information.

Pages that the scanner read well are labelled by patterns that lean on context (what introduces a value) and on
lists learnt from the pages themselves (forenames are what ships and saints are called). Patterns this narrow miss damaged
values, so they only label; the tagger learns from clean text into which scanner damage is put afterwards, and finds
values that no pattern matches. Stretches where a cue stands without a label are left out of training.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "person")
_BREAK = re.compile(r"[-‐‑¬­]\n")
#: Titles by language; "M." is a title in French and an initial elsewhere.
_TITLES = {
    "en": r"(?:Mr|Mrs|Miss|Ms|Dr|Ald|Rev|Capt|Prof|Sir|Col|Major|Lady|Cllr|Sgt)\b\.?",
    "de": r"(?:Herrn?|Frau|Frl|Fräulein|Dr|Pfarrer|Pfr|Prof|Hr|Fr)\b\.?",
    "fr": r"(?:Mme|Mlle|M|Me|Maître|Dr|Docteur|Abbé|Madame|Monsieur|Vve)\b\.?",
}
_CAP = r"[A-ZÀ-ÖØ-Þ][\wÀ-ÿ'’]+(?:-[A-ZÀ-ÖØ-Þ][\wÀ-ÿ'’]+)?"
_INITIALS = r"(?:[A-ZÀ-ÖØ-Þ]\. ?){1,3}"
_EMAIL = re.compile(r"[\w.+-]+ ?(?:@|©|®|\(at\)|\[at\]|\bat\b) ?[\w-]+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[\w-]+)*? ?(?:\.|\(dot\)|\[dot\]| dot ) ?(?:example|test|invalid)\b", re.I)
_PHONE = re.compile(r"(?:\+|\(|\b)\d[\d ()./-]{5,20}\d")
#: Number ranges reserved for fiction, as digit strings.
_CORES = ("79460", "1632960", "55501", "19900", "3023125")
_ID = re.compile(r"\(([^\d()]{3,40}?)[ :]+((?=(?:[^()]*\d){5})[A-Z0-9][A-Z0-9 -]{5,24})\)")
_STREET_EN = r"(?:Street|Road|Lane|Avenue|Yard|Hill|Terrace|Row|Close|Square|Walk|Court|Gate|Green|St|Rd|Ave|Ln)\b\.?"
_ADDRESS = re.compile(
    rf"\b\d+(?:/\d+)? ?[a-zA-Z]? (?:The )?(?:{_CAP} ){{1,2}}{_STREET_EN}"
    r"|\b\d+(?: ?[a-z])?(?: (?:bis|ter))?,? (?:rue|avenue|av\.?|boulevard|bd\.?|place|impasse|chemin|quai|allée|cours|passage)\b (?:(?:de la|de l['’]|du|des|de|d['’]) ?)?[A-ZÀ-Þ][\w'’À-ÿ-]+"
    r"|\b(?:(?:Am|An der|Zum|Zur|Im|Auf dem|Alte|Alter|Große|Kleine) )?[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|gasse|allee|weg|platz|ufer|damm|Straße|Gasse|Weg|Platz) \d+ ?(?:[a-z]\b)?(?!\d|[.,]\d| ?Mark)",
)
_CUES = re.compile(
    r"went to|taken by|should go to|Records show|remembered|reached on|writing to|let to|TUITION by|said the|Akten steht|Vorsitz führte|beantwortet|erklärte|wurde an|présidée par|S'adresser|registre cite|a déclaré|louée? à [A-ZMD]|[Tt]el\.|Tél|Phone|Telephone|Ring |Call |Appeler|Ruf|Mail|[Ee]-?mail|Courriel|Write to|Écrire|Reward\.|@|©|\(at\)",
)


def language(text: str) -> str:
    """en, de or fr by the commonest small words."""
    t = f" {text.lower()} ".replace("\n", " ")
    n = {k: sum(t.count(f" {w} ") for w in ws) for k, ws in {"en": ("the", "of", "was", "at"), "de": ("der", "die", "wird", "und"), "fr": ("la", "le", "les", "par")}.items()}
    return max(n, key=n.get)


@dataclass
class Lists:
    """Forenames and surnames seen in clean pages."""

    forenames: set[str]
    surnames: set[str]


def learn_lists(texts: list[str]) -> Lists:
    """Forenames from ships and saints and before known surnames; surnames after titles and forenames."""
    flat = [_BREAK.sub("", t).replace("\n", " ") for t in texts]
    fore: Counter[str] = Counter()
    for t in flat:
        fore.update(re.findall(r"(?:[Ss]teamer|Dampfer|[Vv]apeur) ([A-ZÀ-Þ][\w'À-ÿ]+) (?:brought|brachte|amène)", t))
        fore.update(re.findall(r"\bSt\. ([A-ZÀ-Þ][\wÀ-ÿ]+)'s", t))
    most = max(fore.values(), default=0)
    forenames = {w for w, n in fore.items() if n >= max(2, most // 40)}
    sur: Counter[str] = Counter()
    for t in flat:
        name = re.compile(rf"(?:{'|'.join(map(re.escape, sorted(forenames)))}|{_TITLES[language(t)]}|\b{_INITIALS}) ?({_CAP})") if forenames else None
        if name:
            sur.update(w for m in name.finditer(t) for w in m[1].split("-"))
    surnames = {w for w, n in sur.items() if n >= 2 and w not in forenames and not w.endswith("'s") and not w.isupper()}
    return Lists(forenames, surnames)


@lru_cache(maxsize=8)
def _person(forenames: tuple[str, ...], title: str) -> re.Pattern:
    fore = "|".join(map(re.escape, forenames))
    up = "|".join(map(re.escape, [w.upper() for w in forenames]))
    initials = (r"(?!M\. )" if title == _TITLES["fr"] else "") + _INITIALS
    caps = r"[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'’]{2,}(?:-[A-ZÀ-ÖØ-Þ'’]{2,})?"
    return re.compile(
        rf"(?:(?P<t1>{title}) )?(?P<a>(?:{fore}) {_CAP}|(?:{up}) {caps}|\b{initials}{_CAP}|{caps}, (?:(?:{fore})\b|(?:{up})\b|{_INITIALS}))"
        rf"|(?P<t2>\b{title}) (?P<b>{_CAP})"
    )


def label(text: str, lists: Lists) -> tuple[list[tuple[int, int, str]], np.ndarray]:
    """Spans (start, end, kind) of a clean text in flow order, and a mask of characters that may be trained on."""
    keep = np.ones(len(text), dtype=bool)
    keep[[i for m in _BREAK.finditer(text) for i in (m.start(), m.start() + 1)]] = False
    at = np.flatnonzero(keep)
    flat = "".join(text[i] for i in at).replace("\n", " ")
    taken = np.zeros(len(flat) + 1, dtype=bool)
    spans: list[tuple[int, int, str]] = []

    def put(a: int, z: int, kind: str) -> None:
        if not taken[a:z].any():
            taken[a:z] = True
            spans.append((a, z, kind))

    for m in _EMAIL.finditer(flat):
        put(m.start(), m.end(), "email")
    for m in _ID.finditer(flat):
        put(m.start(2), m.end(2), "id_number")
    for m in _PHONE.finditer(flat):
        digits = re.sub(r"\D", "", m[0].replace("(0)", ""))
        before = flat[max(0, m.start() - 12) : m.start()]
        if any(c in digits for c in _CORES) and 7 <= len(digits) <= 13 and not re.search(r"(?:No|Nr|item|Entry|Nummer|pièce|Box|Lot)\.? $", before):
            put(m.start(), m.end(), "phone")
    for m in _ADDRESS.finditer(flat):
        put(m.start(), m.end(), "address")
    known = lists.forenames | {w.upper() for w in lists.forenames}
    sure = lists.surnames | {w.upper() for w in lists.surnames}
    for m in _person(tuple(sorted(lists.forenames)), _TITLES[language(flat)]).finditer(flat):
        group = "a" if m["a"] else "b"
        parts = set(re.split(r"[ ,.-]+", m[group]))
        before = flat[max(0, m.start() - 10) : m.start()]
        if (parts & sure or parts & known) and not re.search(r"(?:[Ss]teamer|Dampfer|[Vv]apeur|St\.) $", before):
            put(m.start(group), m.end(group), "person")
    spans.sort()
    good = np.ones(len(text), dtype=bool)
    covered = np.array([x for a, z, _ in spans for x in (a, z)] or [-(10**6)])
    for m in _CUES.finditer(flat):
        near = np.abs(covered - (m.start() + m.end()) / 2).min()
        if near > 45 and not re.match(r"(?:Box|\d+\b)", flat[m.end() : m.end() + 8].strip()):
            good[at[max(0, m.start() - 40)] : at[min(len(at) - 1, m.end() + 60)]] = False
    return [(int(at[a]), int(at[z - 1]) + 1, k) for a, z, k in spans], good
