"""Garbled text made from clean text is found and restored; clean text is left alone."""

import random

import pytest

from tidewater.llm.garbling import Model, contexts, inverse, label, repair, restore, train

CLEAN = [
    "The café at Saint-Érable serves the stevedores’ office.", "Das Schiff lädt in Köllinhafen für 300 € je Bündel.", "La bodega número 14 necesita reparación mañana.", "Demurrage of £ 48 per day – or pro rata – applies.",
    "Судно прибыло в порт и стало под погрузку.", "Przegląd urządzeń dźwigowych wykonała załoga.", "SÃO DE RESPONSABILIDADE DO AFRETADOR", "│ Hold 1 │ 8,826 │", "Bunker was 29 °C, 22 kg/m³, ± 1 ‰.",
]


@pytest.fixture(scope="module")
def model():
    from collections import Counter

    c = Counter()
    for t in CLEAN:
        for x in contexts(t):
            c[x[2:]] += 200
    return train(c)


@pytest.mark.parametrize("pair", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac-roman"), ("cp1251", "cp1252"), ("cp1252", "mac-roman"), ("utf-8", "cp850")])
def test_restores(model, pair):
    def wrong(text):
        data = text.encode(pair[0])
        out = []
        for b in data:
            try:
                out.append(bytes([b]).decode(pair[1]))
            except UnicodeDecodeError:
                out.append(chr(b))
        return "".join(out)

    for text in CLEAN:
        try:
            bad = wrong(text)
        except UnicodeEncodeError:
            continue
        if bad != text and not text.startswith("│"):
            got, pairs, lost = restore(bad, model)
            assert pairs, (pair, bad)
            assert got == text or pair[0] != "utf-8", (pair, bad, got)


def test_clean_text_stays(model):
    for text in [*CLEAN, "", "plain"]:
        assert label(text, model) == [] and restore(text, model) == (text, [], False)


def test_partly_and_twice(model):
    half = "Köllinhafen is fine. " + "Saint-Érable, número".encode().decode("cp1252", "replace")
    assert restore("Köllinhafen ok, Saint-Ã‰rable nÃºmero", model)[0] == "Köllinhafen ok, Saint-Érable número" and half
    assert restore("caf� x", model)[1:] == (["lost"], True)


def test_inverse_is_exact():
    random.seed(1)
    for pair in (("utf-8", "cp1252"), ("cp1251", "cp1252"), ("koi8-r", "cp1251")):
        text = "".join(random.choices("äöüéñабвгд" if pair[0] == "utf-8" else "абвгдежз", k=30))
        bad = "".join(bytes([b]).decode(pair[1]) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D, 0x98) else chr(b) for b in text.encode(pair[0]))
        assert inverse(bad, pair) == (text, 0)


def test_operator_edges(spark):
    rows = [(i, t) for i, t in enumerate(CLEAN * 60)] + [(9001, "Saint-Ã‰rable cafÃ©"), (9001, "Saint-Ã‰rable cafÃ©"), (9002, None), (9003, ""), (None, "cafÃ©"), (9004, "caf�"), (9005, "plain " * 50000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, body string, restored string")
    got = {r.chunk_id: (r.restored, r.lost) for r in repair(df).collect()}
    assert got == {9001: ("Saint-Érable café", False), 9004: ("caf�", True)}
    assert repair(df.where("false")).count() == 0
    assert repair(df.where("id = 9005"), model=Model({})).count() == 0
