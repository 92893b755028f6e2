from __future__ import annotations

import random

import pytest

from documents_fixture import documents  # noqa: F401
from postlens.llm import tokens
from postlens.llm.tokens import VOCABULARY, Tree, encoder

_PARTS = ["a", "b", " ", "  ", "\n", "'", "s", "'ll", "l", "r", "e", "!", "é", "1", "23", "\t", "世", "the", " of"]


def _text(rng, n):
    return "".join(rng.choice(_PARTS) for _ in range(n))


def _full(text):
    return len(encoder(VOCABULARY).encoding.encode_ordinary(text))


def test_edits_equal_full_counts():
    rng = random.Random(1)
    for size in (0, 1, 5, 60, 800, 3000) * 6:
        text = _text(rng, size)
        tree = Tree(encoder(VOCABULARY), text)
        for _ in range(15):
            start, length = rng.randrange(-3, len(text) + 4), rng.choice([0, 0, 1, 2, 5, 40, 400])
            insert = _text(rng, rng.choice([0, 0, 1, 2, 20, 300]))
            low = min(max(start, 0), len(text))
            high = min(max(start + length, low), len(text))
            text = text[:low] + insert + text[high:]
            tree.edit(start, length, insert)
            assert tree.text == text and tree.n_tokens == _full(text) and tree.chars[1] == len(text)
            for heap in (tree.chars, tree.tokens):
                assert all(heap[i] == heap[2 * i] + heap[2 * i + 1] for i in range(1, tree.width))


def test_only_the_edited_region_is_encoded_again():
    text = "some words of a long text, " * 4000
    tree = Tree(encoder(VOCABULARY), text)
    assert tree.edit(50_000, 5, "other") < 1_000 and tree.n_tokens == _full(tree.text)


def test_tables(spark, documents):
    long = "many words here, " * 20_000
    rows = [(1, "It's the first text"), (2, None), (3, ""), (4, long), (5, "twice"), (5, "twice again"), (None, "no id"), (None, None), (6, None)]
    edits = [
        (1, 2, 0, 0, "Now "), (1, 1, 4, 4, " "), (2, 1, 0, 5, "from nothing"), (3, 1, 7, 1, "new"), (4, 1, 1000, 10, None),
        (5, 1, None, None, "!"), (99, 1, 0, 0, "lost"), (None, 1, 0, 0, "lost"),
    ]
    state = tokens.counted(documents(rows))
    assert {(r.doc_id, r.text, r.n_tokens) for r in state.collect()} == {(i, t, _full(t or "")) for i, t in rows}
    changes = spark.createDataFrame(edits, "doc_id long, seq int, start int, length int, insert string")
    out = tokens.edited(state, changes).collect()
    expected = {
        (1, "Now It's  first text", 2), (2, "from nothing", 1), (3, "new", 1), (4, long[:1000] + long[1010:], 1),
        (5, "!twice", 1), (5, "!twice again", 1), (None, "no id", 0), (None, None, 0), (6, None, 0),
    }
    assert {(r.doc_id, r.text, r.n_edits) for r in out} == expected
    assert all(r.n_tokens == _full(r.text or "") for r in out)
    again = tokens.edited(tokens.edited(state, changes).select(*state.columns), changes).collect()
    assert all(r.n_tokens == _full(r.text or "") for r in again)


@pytest.mark.parametrize("side", ["documents", "edits"])
def test_empty(spark, documents, side):
    state = tokens.counted(documents([] if side == "documents" else [(1, "a")]))
    edits = spark.createDataFrame([(1, 1, 0, 0, "x")], "doc_id long, seq int, start int, length int, insert string")
    out = tokens.edited(state, edits if side == "documents" else edits.limit(0)).collect()
    assert [r.text for r in out] == ([] if side == "documents" else ["a"])
