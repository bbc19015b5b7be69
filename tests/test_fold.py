"""Normalisation by its short ways, against the plain one."""

import random
import unicodedata

from kinloom.functions import text as X

ODD = ["\u0085", " ", " ", "\n", "\r\n", "\x1c", "\x1d", " ", "é", "é", "̄", "“", "…", "ß", "İ", "ﬁ", "½", "_", "+", "-", "?!", "a", "Z", "9", "𝔸", "中", " ", "\x0b", "हि"]


def plain(x):
    return " ".join(unicodedata.normalize("NFKD", x.casefold()).translate(X._PLAIN).split())


def test_folded_by_marks():
    rng = random.Random(3)
    texts = [chr(c) for c in range(0x3100)] + [f"Aé {chr(c)}-ñx" for c in range(0x3100)] + ["".join(rng.choices(ODD, k=rng.randrange(12))) for _ in range(5000)]
    assert [X.folded(t) for t in texts] == [plain(t) for t in texts]


def test_ascii_texts_pass_no_table_of_all_characters(monkeypatch):
    class Never(dict):
        def __missing__(self, code):
            raise AssertionError("each character was looked up")

    monkeypatch.setattr(X, "_PLAIN", Never())
    assert X.folded("Crème Brûlée, Ångström & Co. — über".replace("— ", "")) == "creme brulee angstrom co uber"
