import random

import numpy as np
import pytest

from tidewell.llm import gate, leaks, pii, pii_labels, tagger
from tidewell.llm.layout import flow

DOC = "doc_id bigint, text string, lines array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>, item_id int, kind string"
ITEM = (
    "When Wexlpessley lost its astrolabe in 1407, stonecutters carried 8662 barrels from Wexllanvcombe to Faldfleuzmere by dovecote. "
    "The planetarium of Braskdormstead, kept in Carvchaudholm since 1852, lists 3336 bookbinders and 6479 anchors, but no tollbook."
)
FILL = "Rain fell on Wendholm for two days and the busy museum was questioned by porters who went home late."


def page(lines, x=100):
    """Text and boxes of lines given as (text, column, inset)."""
    return "\n".join(t for t, *_ in lines), [(x + 400 * c + i, 30 * k, 0, 0, 0.9) for k, (t, c, i) in enumerate(lines)]


def order(text, boxes):
    x, y = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])
    return [(text[a:z], ad) for a, z, ad in flow(text, x, y)]


def test_reading_order():
    text, boxes = page([("one", 0, 0), ("three", 1, 0), ("two", 0, 2), ("AD", 0, 14), ("", 1, 0), ("four", 1, 0)])
    assert order(text, boxes) == [("one", False), ("two", False), ("AD", True), ("three", False), ("four", False)]
    gap = "left one       right one\nleft two       right two\nleft three     right three\nend"
    assert [text[a:z] for text in [gap] for a, z, _ in flow(gap, None, None)] == ["left one", "left two", "left three", "end", "right one", "right two", "right three"]
    assert flow("", None, None) == [] and flow(" \n ", np.array([1, 1]), np.array([1, 2])) == []
    assert [z - a for a, z, _ in flow("a\nbc", np.array([1]), np.array([1]))] == [1, 2]


def found(spark, docs, items, **kw):
    rows = [(d, t, b, 1, "x") for d, t, b in docs]
    df = spark.createDataFrame(rows, DOC)
    it = spark.createDataFrame(items, "item_id bigint, text string, doc_id int")
    return sorted(map(tuple, leaks.find_leaks(df, it, **kw).select("doc_id", "item_id").collect()))


def wrap(words, n):
    return [" ".join(words[i : i + n]) for i in range(0, len(words), n)]


def test_leaks(spark):
    w = ITEM.split()
    rng = random.Random(1)
    shuffled = w[:]
    rng.shuffle(shuffled)
    like = ITEM.translate(str.maketrans("0123456789", "9876543210")).replace("Wexl", "Marn").replace("Carvchaud", "Stavtrev").replace("Brask", "Quill").replace("Faldfleuz", "Orvlanv").replace("astrolabe", "carillon").replace("planetarium", "seismograph").replace("barrels", "kites").replace("bookbinders", "glovers").replace("anchors", "saddles").replace("stonecutters", "fiddlers")
    misread = ITEM.replace("e", "c").replace("h", "b").upper().replace("O", "0")
    gone = [x for i, x in enumerate(w[:20]) if i not in (4, 11)]
    broken = (FILL + " " + ITEM).replace("stonecutters", "stone-\ncutters").replace("Faldfleuzmere", "Faldfl\neuzmere")
    columns = []
    for left, right in zip(wrap(w, 4), wrap((FILL + " " + FILL).split(), 4), strict=False):
        columns += [(left, 0, 0), (right, 1, 0)]
    advert = [(t, 0, 0) for t in wrap(w[:18], 6)]
    advert.insert(1, ("GRAND SALE of every lantern and boiler", 0, 15))
    inside = " ".join(w[:8]) + "\nFOR SALE busy boiler, hardly used, 54 crowns.\nBox 7.\n" + " ".join(w[8:17])
    docs = [
        (1, FILL + " " + ITEM, None),
        (2, FILL, None),
        (3, " ".join(w[3:18]), None),
        (4, " ".join(w[3:15]), None),
        (5, " ".join(shuffled), None),
        (6, like, None),
        (7, misread, None),
        (8, " ".join(gone), None),
        (9, broken, None),
        (10, *page(columns)),
        (11, *page(advert)),
        (12, inside, None),
        (13, None, None),
        (14, "", []),
        (15, (FILL + "\n") * 2000 + ITEM, None),
    ]
    items = [(1, ITEM, 1), (2, None, 1), (3, "", 1), (4, "too short", 1), (1, ITEM, 2)]
    want = [(d, 1) for d in (1, 3, 7, 8, 9, 10, 11, 12, 15)]
    assert found(spark, docs, items) == want
    assert found(spark, docs + docs[:1], items, block_bytes=2000) == want
    assert found(spark, docs, items[1:4]) == [] and found(spark, docs, []) == [] and found(spark, [], items) == []


def test_items_filed_often_and_shared_passages_leak(spark):
    copies = [(i, ITEM, 1) for i in range(1, 21)]
    assert found(spark, [(1, ITEM, None)], copies) == [(1, i) for i in range(1, 21)]
    rest = [[f"{w}{i}x" for w in ("abbot", "birch", "cloud", "delta", "ember", "flint", "grove", "heron")] for i in range(20)]
    sharing = [(i, " ".join(r[:4] + ITEM.split()[:15] + r[4:]), 1) for i, r in enumerate(rest)]
    assert found(spark, [(1, FILL + " " + " ".join(ITEM.split()[:15]), None)], sharing) == [(1, i) for i in range(20)]


def test_passages_left_with_one_rare_word_leak(spark):
    rng = random.Random(4)
    common = [a + b for a in ("stone", "river", "market", "harbour", "chapel") for b in ("gate", "ward", "man", "side", "yard", "house")]
    letters = "reghwtpxz"  # of different classes
    items = []
    for i in range(9):
        w = rng.sample(common, 24)
        items.append((i, " ".join(x for n in range(8) for x in [*w[3 * n : 3 * n + 3], f"quix{letters[n] * 4}{letters[i] * 4}"]), 1))
    quoted = [["exchanged" if n in (7, 11) else x for n, x in enumerate(t.split())][4:19] for _, t, _ in items]
    docs = [(i, FILL + " " + " ".join(q) + ". " + FILL, None) for i, q in enumerate(quoted)]
    assert found(spark, docs, items) == [(i, i) for i in range(9)]


def test_close_words_and_masks():
    assert leaks.close(leaks.fold("Braskdormstead"), leaks.fold("Bnaskdormstcad")) and leaks.close("abcdef", "abdef")
    assert not leaks.close("abcd", "abd") and not leaks.close(leaks.fold("Orvvignhaven"), leaks.fold("Orvvignburn"))
    ids = np.arange(8).astype(np.uint64)
    a = leaks.placed(ids)[0]
    other = ids.copy()
    other[3] = 99  # an exchanged word under an ignored position
    assert set(leaks.placed(other)[0].tolist()) & set(a.tolist())
    assert not len(leaks.placed(ids, np.zeros(8, dtype=bool))[0])


def test_a_passage_shared_by_any_number_of_items(spark):
    """Items with a passage of 30 words in common, among others, all leak, whatever the blocks."""
    rng = random.Random(8)
    syllables = [a + b for a in "bdfgkmprstz" for b in ("arn", "elt", "isk", "ovv", "ump", "yth", "orf", "ald")]
    word = lambda: "".join(rng.choices(syllables, k=2))
    for many in (4, 13, 200):
        stem = [word() for _ in range(30)]
        items = [(i, " ".join(stem + [word() for _ in range(10)] + ["Which?"]), 1) for i in range(many)] + [(1000 + i, " ".join(word() for _ in range(40)), 1) for i in range(50)]
        docs = [(1, FILL + " " + " ".join(stem[5:25]) + " " + FILL, None), (2, FILL, None)]
        want = [(1, i) for i in range(many)]
        assert found(spark, docs, items) == want
        if many == 13:
            assert found(spark, docs, items, block_bytes=20_000) == want


def test_tagger_gradient():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in tagger.new_weights(1, 4).items()}
    x, y = rng.integers(0, 100, (6, 3)), np.zeros((6, 3), dtype=int)
    y[2], y[3] = 1, 2
    _, g = tagger.loss_and_gradient(x, y, w)
    for k in ("hf", "hb", "o", "c", "t"):
        i = np.unravel_index(int(np.abs(g[k]).argmax()), g[k].shape)
        d, old = 1e-2, w[k][i]
        w[k][i] = old + d
        up = tagger.loss_and_gradient(x, y, w)[0]
        w[k][i] = old - d
        down = tagger.loss_and_gradient(x, y, w)[0]
        w[k][i] = old
        assert (up - down) / 2 / d == pytest.approx(g[k][i], rel=2e-2)


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(2)
    trans = tagger.forbidden() + rng.normal(size=(tagger.K, tagger.K)).astype(np.float32)
    e = rng.normal(size=(3, 2, tagger.K)).astype(np.float32)
    got = tagger.viterbi(e, np.array([3, 2]), trans)
    for b, n in ((0, 3), (1, 2)):
        ok = [p for p in itertools.product(range(tagger.K), repeat=n) if tagger.TAGS[p[0]][0] != "I"]
        best = max(ok, key=lambda p: sum(e[t, b, p[t]] for t in range(n)) + sum(trans[p[t], p[t + 1]] for t in range(n - 1)))
        assert tuple(got[:n, b]) == best
    assert got[2, 1] == 0


def test_gate_covers_what_it_was_fitted_on():
    text = "nothing here " * 9 + "call 414-555-0101 now " + "nothing here " * 9
    c = tagger.codes(text)
    tags = np.zeros(len(c), dtype=np.int64)
    at = text.index("414")
    tags[at : at + 12] = 4
    w = gate.fit([(c, tags)])
    (a, z), *more = gate.stretches(c, w, -1.0)
    assert a <= at < at + 12 <= z and not more and gate.stretches(c[:0], w, -1.0) == [] and len(gate.scores(c[:3], w)) == 3


PAGE = (
    "The chair was taken by Mr. Simon Carvelle of Oakham. Records show Dr. Luddaway (passport no. X0499156) as owner of the mill. "
    "Prudence Stavesby may be reached on 01632 960123 or by writing to prudence.stavesby@harbourmail.example. The steamer Barnaby brought 41 "
    "nurses from Millford. The tannery was let to Hester Molvimore, of 12 Chapel Hill, Ashley. The vote stood at 41-17 and the lamp under item 1934-77-20 was sold."
)


def spans(text, x0=None, y0=None):
    return pii.spans([text], [(x0, y0)], pii.load(pii.WEIGHTS))[0]


def test_personal_information(spark):
    want = {("person", "Simon"), ("person", "Luddaway"), ("id_number", "X0499156"), ("person", "Prudence"), ("phone", "01632"), ("email", "prudence.s"), ("person", "Hester"), ("address", "12 Chapel")}
    assert {(k, PAGE.index(s)) for k, s in want} == {(k, r[0][0]) for k, r in spans(PAGE)}
    rows = [(1, PAGE, None, 1, "x"), (2, None, None, 1, "x"), (3, "", [], 1, "x"), (4, "\n \n", None, 1, "x"), (5, PAGE * 40, None, 1, "x"), (1, PAGE, None, 1, "x")]
    df = spark.createDataFrame(rows, DOC)
    got = pii.find_personal(df).groupBy("doc_id").count().collect()
    got = {r.doc_id: r["count"] for r in got}
    assert got[1] == 16 and abs(got[5] - 320) <= 4 and set(got) == {1, 5}
    new = {r.doc_id: (r.text, r.n_found) for r in pii.redact(df).collect()}
    assert new[2] == (None, 0) and new[3] == ("", 0)
    text = new[1][0]
    assert "Mr. [PERSON] of Oakham" in text and "[EMAIL]" in text and "[PHONE]" in text and "Stavesby" not in text and "brought 41" in text
    assert pii.find_personal(df.where("false")).count() == 0


def test_broken_values_are_found_where_they_begin():
    text, boxes = page([("Some porters saw Prudence Stavesby may be rea-", 0, 0), ("Rain fell on Wendholm for 2", 1, 0), ("ched on 01632 960", 0, 0), ("days and the museum was", 1, 0), ("123 or by writing.", 0, 0), ("sold.", 1, 0)])
    got = spans(text, np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes]))
    phone = [r for k, r in got if k == "phone"]
    assert phone and phone[0][0][0] == text.index("01632") and len(phone[0]) == 2
    clean = pii.redacted(text, [("phone", phone[0])])
    assert "[PHONE]" in clean and "960" not in clean and "\n123" not in clean and "days and the museum" in clean


def test_held_out_accuracy_of_the_tagger():
    """Clean and damaged sentences with made-up values: most starts are found, and little else."""
    from tidewell.llm.pii_training import damage

    rng = np.random.default_rng(5)
    text = PAGE
    tags = np.zeros(len(text), dtype=np.int8)
    for k, s in (("person", "Simon Carvelle"), ("id_number", "X0499156"), ("person", "Prudence Stavesby"), ("phone", "01632 960123"), ("email", "prudence.stavesby@harbourmail.example"), ("person", "Hester Molvimore"), ("address", "12 Chapel Hill"), ("person", "Luddaway")):
        i = tagger.TAGS.index(f"I-{k}")
        a = text.index(s)
        tags[a : a + len(s)], tags[a] = i, i - 1
    hit = there = said = 0
    for _ in range(60):
        t, y = damage(text, tags, rng)
        heads = {(pii_labels.KINDS[(int(y[i]) - 1) // 2], int(i)) for i in np.flatnonzero(y % 2 == 1)}
        got = {(k, r[0][0]) for k, r in spans(t)}
        hit, there, said = hit + len(heads & got), there + len(heads), said + len(got)
    assert hit / there > 0.9 and hit / said > 0.9


#: Sentences written by hand, of no page and no generator: formats and contexts that were not fitted.
BY_HAND = [
    ("Please write to maria_lopez@company.org soon.", [("email", "maria_lopez@company.org")]),
    ("Contact john.smith@gmail.com for details.", [("email", "john.smith@gmail.com")]),
    ("Call 0161 496 2231 or 020 8743 1922 today.", [("phone", "0161 496 2231"), ("phone", "020 8743 1922")]),
    ("He lives at 742 Evergreen Terrace in town.", [("address", "742 Evergreen Terrace")]),
    ("Passport No. 533380006 was lost.", [("id_number", "533380006")]),
    ("SSN 219-09-9999 and phone (415) 555-2671.", [("id_number", "219-09-9999"), ("phone", "(415) 555-2671")]),
    ("The firm moved to 15 Rosewood Drive in spring.", [("address", "15 Rosewood Drive")]),
    ("Bitte rufen Sie 0421 339870 an oder schreiben Sie an kasse@stadtbad-nord.de.", [("phone", "0421 339870"), ("email", "kasse@stadtbad-nord.de")]),
    ("Frau Tilda Bergmann wohnt in der Rosenstraße 27.", [("person", "Tilda Bergmann"), ("address", "Rosenstraße 27")]),
    ("Elle habite 8 rue des Tanneurs et son numéro est le 04 72 61 15 90.", [("address", "8 rue des Tanneurs"), ("phone", "04 72 61 15 90")]),
    ("Questions go to h.okafor@lib.bristol.ac.uk before Friday.", [("email", "h.okafor@lib.bristol.ac.uk")]),
    ("Mr. Kwame Mensah said that the vote of 41-17 was fair.", [("person", "Kwame Mensah")]),
    ("His licence number MORGA657054SM9IJ has expired.", [("id_number", "MORGA657054SM9IJ")]),
    ("The lamp under item 1934-77-20 was sold for 12 crowns in 1907.", []),
]


def test_formats_that_were_never_fitted():
    hit = there = said = 0
    for text, want in BY_HAND:
        got = {(k, r[0][0]) for k, r in spans(text)}
        starts = {(k, text.index(v)) for k, v in want}
        hit, there, said = hit + len(got & starts), there + len(starts), said + len(got)
    print(hit, there, said)
    assert hit / there >= 0.85 and hit / said >= 0.85


def test_decoding_in_parts_is_decoding_whole(monkeypatch):
    whole = spans(PAGE * 5)
    monkeypatch.setattr(pii, "NEAR", -1e9)
    assert spans(PAGE * 5) == whole
