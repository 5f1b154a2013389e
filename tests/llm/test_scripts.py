import pytest

from litweave.llm.lookalike import OTHERS, normalize


@pytest.mark.parametrize("text, want", [("Ꭺpen", "Apen"), ("lɑbel", "label"), ("ꓮpen", "Apen"), ("ⲟpen", "open"), ("an enɡine", "an engine"), ("ꓐook of ꓢꓣ", "Book of SR"), ("ᎷᎪᏦE it", "MAKE it")])
def test_look_alikes_of_other_scripts(text, want):
    assert normalize(text) == (want, frozenset(["lookalike"]))


@pytest.mark.parametrize("text", ["Yıldız", "[ɡəʊ]", "ɑ", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "ꓡꓲ‐ꓢꓴ", "Ⲙⲉⲧⲣⲉⲙⲛⲕⲏⲙⲓ", "the α-test", "Москва"])
def test_words_of_other_scripts_are_left(text):
    assert normalize(text)[0] == text


def test_tables_are_whole():
    assert all(len(k) == len(v) == 1 for letters in OTHERS.values() for k, v in letters.items()) and [len(x) for x in OTHERS.values()][3:] == [21, 25, 14]
