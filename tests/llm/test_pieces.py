import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from textloom.llm import sentencepiece_bpe as P

BITS = ["a", "b", "th", "er", "ing", " ", "  ", "\n", "\t", "▁", "é", "漢", "\U0001F600", "\0", "<s>", "</s>", "<0x0A>", ".", "..", ",", "'", "�",
        "​", "\xa0", "한국", "привет", "\r\n", "1", "23", "=", "==", "{", "}", "//"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want(library, text):
    ids = library.encode(text or "", add_eos=True)
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))


@pytest.mark.parametrize("short", [0, 32])
@pytest.mark.parametrize("block", [1 << 18, 7])
def test_agenda_equals_the_library(library, monkeypatch, short, block):
    monkeypatch.setattr(P, "SHORT", short)
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "CACHE", 50)
    enc = P.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    for _ in range(1500):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 30)))
        ids = library.encode(text, add_eos=True)
        assert enc.encode(text) == (ids, library.decode(ids))
        assert enc.digests(text, *enc.learn_all([text])) == (*want(library, text), 0)
        assert enc.texts(text) == (" ".join(map(str, ids)), library.decode(ids))
    run = "x" * 20000 + "=" * 3000
    assert enc.encode(run)[0] == library.encode(run, add_eos=True)


def test_the_check_lets_the_library_win(library):
    enc = P.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    del enc.rank["▁th"], enc.rank["he"]
    assert enc.digests("on the hill the end")[:3] == want(library, "on the hill the end") and enc.digests("on the hill the end")[3] == 2


def test_pieces_of_documents(library, edge_docs, edge_rows, no_docs):
    got = [tuple(r) for r in P.piece_bpe(edge_docs).collect()]
    assert sorted(got, key=str) == sorted(((r[0], *want(library, r[1]), 0) for r in edge_rows), key=str)
    assert P.piece_bpe(no_docs).collect() == []
    full = {r.ids: r.decoded for r in P.piece_bpe(edge_docs, full=True).collect()}
    assert all(library.decode([int(i) for i in ids.split()]) == text for ids, text in full.items()) and full["2"] == ""


def test_other_models_are_refused(spark):
    with pytest.raises(Exception):
        P.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
