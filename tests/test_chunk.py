"""Chunkers: literal cases and invariants."""

import random

import pytest

from corpusflow.operators.chunk import STRATEGIES, paragraph_window, sentence_window, table_window


def test_sentences():
    assert sentence_window("A short sentence.") == ["A short sentence."]
    out = sentence_window("This is a sentence. " * 10, 50, 10)
    assert len(out) > 1 and all(len(c) <= 51 for c in out)
    assert sentence_window("x" * 100, 40, 0) == ["x" * 40, "x" * 40, "x" * 20]
    assert sentence_window("   ", 10, 2) == []


def test_tables():
    table = "| Drug | Dose |\n|---|---|\n| aaaaa | 1 mg |\n| bbbbb | 2 mg |\n| ccccc | 3 mg |\n| ddddd | 4 mg |"
    out = table_window(table, 45)
    assert len(out) > 1 and all(c.startswith("| Drug | Dose |\n|---|---|") for c in out)
    assert table_window("The cost is |20 depending on | what you take.") == ["The cost is |20 depending on | what you take."]
    assert table_window("| only header that is long |\n|---|", 10) == []
    assert table_window("intro\n| a | b |\n| c | d |\nend", 1500) == ["intro", "| a | b |\n| c | d |", "end"]


def test_paragraphs():
    assert paragraph_window("AAAAAAAA\n\nBB\n\nCCCCCCCCCC", 5, 8, 3, 0)[1].startswith("BB")
    assert len(paragraph_window("long paragraph\n\nTiny.", 5, 1000, 50, 0)) == 1
    assert sum(map(len, paragraph_window("a" * 300, 50, 100, 5, 5))) >= 300


@pytest.mark.parametrize("name", STRATEGIES)
def test_every_word_survives(name):
    rng = random.Random(1)
    text = ""
    while len(text) < 20_000:
        text += rng.choice(["word", "Satz", "één"]) * rng.randint(1, 3) + rng.choice([" ", ". ", "\n\n", "? ", "\n"])
    found = " ".join(STRATEGIES[name](text)).split()
    assert set(text.split()) <= set(found)
