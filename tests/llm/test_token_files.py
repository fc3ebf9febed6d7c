import zlib

import numpy as np
import pytest
from conftest_path import documents
from hypothesis import given
from hypothesis import strategies as st
from sedimenta.llm import token_files as tf
from sedimenta.llm.pieces import default_vocabulary


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=60))
def test_codes_round_trip(values):
    control, data = tf.pack(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert tf.unpack(control, data, len(values)).tolist() == values


def want(rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(default_vocabulary())
    out, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    return out


@pytest.mark.parametrize("block", [16, 1 << 16])
def test_files_round_trip(spark, tmp_path, monkeypatch, messy, block):
    monkeypatch.setattr(tf, "BLOCK", block)
    folder = f"file://{tmp_path}/tokens"
    tf.write_tokens(messy, folder)
    rows = sorted([tuple(r) for r in tf.read_tokens(spark, folder, with_ids=True).collect()], key=lambda r: r[1])
    expected = want(documents())
    assert [r[0] for r in rows] == [r[0] for r in expected]
    assert [r[1] for r in rows] == list(np.cumsum([0] + [r[2] for r in rows])[:-1])
    # rows that share an id come in the order they were read
    assert sorted((r[0] is None, r[0] or 0, r[2], r[3], bytes(r[4])) for r in rows) == sorted((r[0] is None, r[0] or 0, r[2], r[3], r[4]) for r in expected)
    once = {r[0] for r in expected if sum(x[0] == r[0] for x in expected) == 1}
    assert {r[:4] for r in rows if r[0] in once} == {r[:4] for r in expected if r[0] in once}


def test_empty(spark, tmp_path, empty):
    tf.write_tokens(empty, f"file://{tmp_path}/none")
    assert tf.read_tokens(spark, f"file://{tmp_path}/none").count() == 0


def test_new_words_skip_the_librarys_splitter(monkeypatch):
    """Words are split already; only pieces that aren't a space and letters go through the library's own pre-tokenizer."""
    coder, seen = tf.LibraryEncoder(default_vocabulary()), []
    through = coder._through
    monkeypatch.setattr(coder, "_through", lambda texts: seen.extend(texts) or through(texts))
    text = "One quick brœwn fox, straße  Ünïcödé 中文 <|endoftext|> it's 12\n zweï\ttions"
    assert np.frombuffer(coder([text])[0], coder.kind).tolist() == coder.lib.encode(text, add_special_tokens=False).ids
    assert {"One", ",", "<|endoftext|>"} <= set(seen) and not any(" quick" in t or " fox" in t for t in seen)
