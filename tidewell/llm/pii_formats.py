"""Made-up personal information in general shapes, for training: values by rule and sentences that carry them.

The pages show one style of each kind only. These values follow the shapes that are in use elsewhere: mail domains of any
name, telephone numbers of several countries, official numbers, streets of three languages and common names.
"""

from __future__ import annotations

import numpy as np

#: Common names and words that values are put together from.
FORENAMES = (
    "James Mary John Linda Robert Susan Michael Karen David Emma William Olivia Richard Sarah Thomas Laura Daniel Anna Paul Alice George Helen Peter Grace Henry Ruth Samuel Maria Carlos Lucia "
    "Ahmed Fatima Wei Mei Ivan Olga Hans Greta Klaus Ingrid Jürgen Ursula Stefan Heike Wolfgang Sabine Pierre Claire Jean Sophie François Élodie Luc Camille Antoine Margaux Noël Amélie"
).split()
SURNAMES = (
    "Smith Johnson Brown Taylor Wilson Davies Evans Walker Wright Robinson Thompson White Hughes Edwards Green Hall Wood Harris Clarke Jackson Turner Hill Cooper Ward Morris Moore Lopez Garcia "
    "Martinez Nguyen Patel Khan Singh Chen Kim Ivanov Novak Kowalski Schmidt Müller Schneider Fischer Weber Becker Schulz Hoffmann Koch Richter Wolf Neumann Schwarz Zimmermann Braun Krüger "
    "Dubois Moreau Laurent Simon Michel Lefèvre Roux Fournier Girard Bonnet Lambert Fontaine Rousseau O'Brien McDonald Fitzgerald Van-Dyke"
).split()
WORDS = "maple river oak north harbour sun stone bright cedar lake hill royal park market union school castle mill field spring elm garden bridge church station forest".split()
SUFFIX_EN = "Street Road Lane Avenue Drive Terrace Way Court Place Close Crescent Boulevard Grove Gardens Row Square Walk Hill St Rd Ave Dr Blvd".split()
SUFFIX_DE = "straße str. weg gasse platz allee ring ufer damm".split()
TYPES_FR = "rue avenue boulevard place impasse chemin quai allée cours".split()
TLDS = "com com org net edu gov co.uk ac.uk de fr io info eu us ca ch at be nl".split()
LEADS = {
    "id_number": (
        "SSN: {}|social security number {}|passport no. {}|Passport No. {}|Passport {}|driver's licence {}|licence number {}|National Insurance number {}|NI no. {}|ID {}|ID number {}|tax number {}|"
        "Personalausweis {}|Ausweisnummer {}|Reisepass Nr. {}|Steuer-ID {}|Sozialversicherungsnummer {}|numéro de sécurité sociale {}|passeport n° {}|carte d'identité {}|N° INSEE {}|member number {}|policy no. {}"
    ).split("|"),
    "phone": (
        "call {}|Call me on {}|phone {}|Phone: {}|Tel. {}|Tel: {}|telephone {}|ring {} after six|mobile {}|fax {}|reach us at {}|Telefon {}|Ruf {}|unter {} erreichbar|Tél. {}|téléphone : {}|appelez le {}|or {} in the evening|({})"
    ).split("|"),
    "email": ("write to {}|email {}|e-mail: {}|mail {}|contact {} for details|send it to {}.|{} answers|E-Mail: {}|schreiben Sie an {}|courriel : {}|écrivez à {}|<{}>|({})|from {}").split("|"),
    "address": ("lives at {}|at {},|of {},|moved to {} last year|{}, second floor|the house at {} was sold|send to {}|wohnt in der {}|zieht in {}|Anschrift: {}|demeure au {}|habite {}|adresse : {}|sis {}").split("|"),
    "person": (
        "said {}.|{} lives here|by {},|Mr. {} said|Mrs. {} wrote|Dr. {} of|signed, {}|contact {} for|{} was born|Herr {} sagte|Frau {} wohnt|von {} gekauft|M. {} a dit|Mme {} habite|selon {},|with {} and|Dear {},"
    ).split("|"),
}


def _pick(rng: np.random.Generator, items: list | tuple) -> str:
    return str(items[rng.integers(len(items))])


def _digits(rng: np.random.Generator, shape: str) -> str:
    """Random digits for # (1 to 9 for N), capitals for A."""
    return "".join(str(rng.integers(10)) if c == "#" else str(rng.integers(1, 10)) if c == "N" else chr(65 + rng.integers(26)) if c == "A" else c for c in shape)


def _plain(name: str) -> str:
    return name.lower().translate(str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "é": "e", "è": "e", "ë": "e", "ç": "c", "'": ""}))


PHONES = (
    "020 #### ####|0161 ### ####|0113 ### ####|01### ######|01### ### ###|07### ######|07### ### ###|+44 20 #### ####|+44 1### ######|+44 (0)7### ######|(N##) ###-####|N##-###-####|N##.###.####|N## ### ####|"
    "+1 N## ### ####|+1-N##-###-####|1-800-###-####|030 ######|030/#######|0### #######|0####/######|+49 ### #######|+49 (0)30 ######|0N ## ## ## ##|0N.##.##.##.##|0N-##-##-##-##|+33 N ## ## ## ##|0033 N ## ## ## ##|"
    "+34 ### ### ###|+41 ## ### ## ##|###-####"
).split("|")
IDS = (
    "N##-##-####|### ## ####|A#######|AA#######|#########|N########|AA ## ## ## A|AA######A|A##A#####A#|A########|## ### ### ###|###########|N ## ## ## ### ### ##|#############|AA-######|A#-####-####|####-####-####|A######-#"
).split("|")


def value(kind: str, rng: np.random.Generator) -> str:
    """One made-up value of a kind."""
    fore, sur = _pick(rng, FORENAMES), _pick(rng, SURNAMES)
    if kind == "phone":
        return _digits(rng, _pick(rng, PHONES))
    if kind == "id_number":
        return _digits(rng, _pick(rng, IDS))
    if kind == "email":
        a, b, n = _plain(fore), _plain(sur), str(rng.integers(1, 2000))
        local = _pick(rng, (f"{a}.{b}", f"{a}_{b}", f"{a[0]}{b}", f"{a}{n}", f"{b}.{a[0]}", f"{a}-{b}", _pick(rng, WORDS) + n, "info", "office", "contact", f"{a}.{b}+{_pick(rng, WORDS)}", f"{a[0]}.{b}"))
        house = _pick(rng, (_pick(rng, WORDS), _pick(rng, WORDS) + _pick(rng, WORDS), _pick(rng, WORDS) + "-" + _pick(rng, WORDS), "mail." + _pick(rng, WORDS), b, "gmail", "company", "web", "post"))
        at = _pick(rng, ("@",) * 8 + (" @ ", "(at)", " [at] ", "©"))
        full = f"{local}{at}{house}.{_pick(rng, TLDS)}"
        return full.upper() if rng.random() < 0.04 else full
    if kind == "address":
        number = _digits(rng, _pick(rng, ("N", "N#", "N##", "N##", "N###", "N#a", "N#-N#")))
        name = _pick(rng, (_pick(rng, WORDS).capitalize(), sur, fore, _pick(rng, WORDS).capitalize() + _pick(rng, WORDS), _pick(rng, ("North", "South", "Old", "New")) + " " + _pick(rng, WORDS).capitalize(), "St. " + fore + "'s"))
        which = rng.integers(4)
        if which == 0:
            return f"{_pick(rng, (_pick(rng, WORDS).capitalize(), sur, 'Haupt', 'Bahnhof', 'Linden', 'Garten'))}{_pick(rng, SUFFIX_DE)} {number}"
        if which == 1:
            return f"{number}{_pick(rng, (' ', ', ', ' bis '))}{_pick(rng, TYPES_FR)} {_pick(rng, ('de la ', 'du ', 'des ', 'de ', ''))}{_pick(rng, (sur, fore + ' ' + sur, 'Paix', 'Gare', 'Victoire'))}"
        return f"{number} {name} {_pick(rng, SUFFIX_EN)}"
    first = _pick(rng, (fore, fore, fore, fore + " " + fore[0] + ".", fore[0] + ".", fore[0] + ". " + _pick(rng, FORENAMES)[0] + ".", fore + " " + _pick(rng, FORENAMES)))
    full = f"{sur}, {first}" if rng.random() < 0.06 else f"{first} {sur}"
    return full.upper() if rng.random() < 0.05 else full


def sentence(rng: np.random.Generator, kinds: tuple[str, ...]) -> tuple[str, list[tuple[int, int, str]]]:
    """A clause or two with values, and their places."""
    out, spans = "", []
    for _ in range(rng.integers(1, 4)):
        kind = _pick(rng, kinds)
        before, after = _pick(rng, LEADS[kind]).split("{}")
        v = value(kind, rng)
        out += (" " if out else "") + before
        spans.append((len(out), len(out) + len(v), kind))
        out += v + after
        out += _pick(rng, ("", ".", ",", ";", " and", " or"))
    return out, spans
