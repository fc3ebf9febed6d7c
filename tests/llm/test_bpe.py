import random

import numpy as np
from conftest_path import documents
from hypothesis import given, settings
from hypothesis import strategies as st
from sedimenta.llm import bpe
from sedimenta.llm.pieces import Vocabulary, default_vocabulary
from tokenizers import Tokenizer

LIB = Tokenizer.from_file(default_vocabulary())
CODER = bpe.TrieEncoder(Vocabulary(default_vocabulary()))


def ids(text):
    return LIB.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab éß'st\n\t1<|endoftext|>", max_size=80))
def test_equals_the_library(text):
    got = np.frombuffer(CODER.encode([text])[0], np.uint32).tolist()
    assert got == ids(text)
    assert CODER.decode(np.array(got, np.uint32).tobytes()) == LIB.decode(got, skip_special_tokens=False)


def test_every_token_encodes_to_itself():
    assert all(CODER._line(t).tolist() == [i] for t, i in list(CODER.v.ids.items())[::7])


def test_cut_tokens_decode_with_replacement():
    some = ids("🤔")[:1]
    assert CODER.decode(np.array(some, np.uint32).tobytes()) == LIB.decode(some, skip_special_tokens=False)


def test_odd_rows(messy, empty):
    rows = bpe.bpe(messy).collect()
    want = sorted((str(d), ids(t or ""), t or "") for d, t, _ in documents())
    assert sorted((str(r.doc_id), np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded) for r in rows) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in rows) and bpe.bpe(empty).count() == 0


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 3)
    monkeypatch.setattr(bpe, "NODES", 5)
    coder = bpe.TrieEncoder(CODER.v)
    for text in ("some words here and more words", "x" * 700, "some other words"):
        assert np.frombuffer(coder.encode([text])[0], np.uint32).tolist() == ids(text)


def test_learning_tries_few_tokens_a_byte(monkeypatch):
    """Compounds, as most new words are: a search of the vocabulary for every suffix of every prefix costs many lookups a byte."""

    class Counted(dict):
        looked = 0

        def get(self, *key):
            Counted.looked += 1
            return super().get(*key)

    vocabulary = Vocabulary(default_vocabulary())
    monkeypatch.setattr(vocabulary, "ids", Counted(vocabulary.ids))
    coder, rng = bpe.TrieEncoder(vocabulary), random.Random(5)
    text = " ".join("".join(rng.choices(["the", "schaft", "ción", "eau", "tion", "ing", "ü", "ß", "中"], k=rng.randint(2, 6))) for _ in range(400)) + " " + "ation" * 80
    Counted.looked = 0
    assert np.frombuffer(coder.encode([text])[0], np.uint32).tolist() == ids(text)
    assert Counted.looked <= len(text.encode())


def test_tasks_of_a_worker_share_a_coder():
    assert bpe.worker_coder(default_vocabulary()) is bpe.worker_coder(default_vocabulary())
