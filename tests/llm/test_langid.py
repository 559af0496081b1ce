import random

import numpy as np
from helpers import SF, awkward, empty

from tableferry.llm import langid
from tableferry.llm.queries import QUERIES


def phrases(text, known):
    """Greedy longest phrases of a text that occur in ``known``; an unknown letter is one."""
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in known:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_automaton_accepts_just_the_substrings():
    rng = random.Random(0)
    text = [rng.randrange(3) for _ in range(60)]
    moves = langid.suffix_automaton(text)
    inside = {tuple(text[i:j]) for i in range(60) for j in range(i, 61)}
    for _ in range(3000):
        word, state = [rng.randrange(3) for _ in range(rng.randrange(1, 8))], 0
        for c in word:
            state = moves[state].get(c) if state is not None else None
        assert (state is not None) == (tuple(word) in inside)


def test_phrases_are_counted_as_by_hand(monkeypatch):
    rng = random.Random(1)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    known = {"aa": make("abc ", 500), "bb": make("bcd ", 500)}
    parser = langid.Parser(langid.model(known))
    for size in (300, 5000):
        text = " ".join(make("abcdz ", size).split())
        codes = parser.codes(text)
        got = parser.entropies([codes, codes[:40]])
        for k, name in enumerate(parser.model.languages):
            at = range(0, len(text), langid.WINDOW)
            count = sum(phrases(text[i : i + langid.WINDOW], parser.model.texts[k]) for i in at)
            assert abs(got[0, k] - count * parser.bits[k] / len(text)) < 1e-9


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    found = QUERIES["op1_language"](spark, sf).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in found if r.held_out]
    assert len(found) == len(truth) and len(held) > 200 and all(0 <= r.score <= 1 for r in found)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_awkward_rows(spark):
    m = langid.model({"en": "the quick word one and", "de": "der schnelle wort eins und"})
    rows = langid.identify(awkward(spark), m, ["doc_id", "hash"]).collect()
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert len(rows) == awkward(spark).count()
    assert [by[k].lang_pred for k in (1, 2, 3, 9)] == ["und"] * 4 and by[1].score == 0
    assert by[4].lang_pred == "en" == by[7].lang_pred
    assert langid.identify(empty(spark), m, ["doc_id"]).count() == 0
    assert langid.train(empty(spark)).languages == ()
    assert {r.lang_pred for r in langid.identify(awkward(spark), langid.model({}), ["doc_id"]).collect()} == {"und"}
