"""The automaton against the public library, on documents and on generated texts."""

import hashlib
import pickle
import random
import time
import tracemalloc
from functools import cache

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from compare import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from episode_mart.llm import bpe
from episode_mart.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


compiled = cache(bpe.compile_file)


@pytest.fixture(scope="module")
def automaton():
    return compiled(PATH)


def test_a_small_automaton_by_hand():
    vocabulary = {b"a": 0, b"b": 1, b"ab": 2, b"aa": 3, b"aab": 4}
    made = bpe.TokenAutomaton(vocabulary, [(b"a", b"b"), (b"a", b"a"), (b"a", b"ab")], {})
    assert made.path(b"aab") == [4]
    assert made.path(b"aaab") == [3, 2]
    assert made.path(b"aaaa") == [3, 3]
    assert made.path(b"aaa") == [3, 0]
    assert made.path(b"bab") == [1, 2]


def test_documents(spark):
    got = {r["doc_id"]: r for r in QUERIES["op6_bpe"](spark, f"{DATA}/sf0.01").collect()}
    for r in pq.read_table(f"{DATA}/sf0.01/documents.parquet").to_pylist():
        ids = LIBRARY.encode(r["text"], add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        mine = got[r["doc_id"]]
        assert mine["n_tokens"] == len(ids)
        assert mine["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert mine["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


ODD = ["", " ", "  \n\n ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "don't we'll I'M", "x" * 3000, "ab" * 2000,
       "  é́ ß Ⅷ ½ 一二三 🙂🏽 \x00\x1f", "aaaaaaaaab" * 50, "    indented\n\tcode  \r\n", "1234567890" * 30]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(automaton, text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert automaton.encode(text) == ids
    assert automaton.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abehinorstu '", max_size=80), st.text("aé ñ.\n", max_size=60)))
def test_any_text(text):
    made = compiled(PATH)
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert made.encode(text) == ids
    assert made.decode(ids) == text


def test_rows_without_text(spark, frame):
    rows = [(1, None, "en"), (2, "", None), (None, "a b", "en"), (2, "", None)]
    got = bpe.encode(frame(rows, "doc_id long, text string, ids string"), PATH).collect()
    assert [(r["ids"], r["decoded"]) for r in got] == [([], ""), ([], ""), ([64, 275], "a b"), ([], "")]
    assert bpe.encode(frame([]), PATH).count() == 0


def test_texts_together_equal_texts_alone(automaton, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)  # remembered words change generations all the time
    texts = [*ODD, "", "the cat", "the cat<|endoftext|>the cat"]
    ids, id_ends, labels, label_ends = automaton.together(texts)
    ids, decoded = ids.to_pylist(), bpe._texts_of(labels, label_ends).to_pylist()
    for i, text in enumerate(texts):
        own = LIBRARY.encode(text, add_special_tokens=False).ids
        assert ids[id_ends[i - 1] if i else 0:id_ends[i]] == own and decoded[i] == LIBRARY.decode(own, skip_special_tokens=False)
    ids, id_ends, labels, label_ends = automaton.together(["", ""])
    assert len(ids) == 0 and id_ends.tolist() == [0, 0] and bpe._texts_of(labels, label_ends).to_pylist() == ["", ""]


def test_a_very_long_word_takes_little_time(automaton):
    for word in ("a" * 200_000, "abc" * 70_000, "étàâ" * 50_000):
        begun = time.perf_counter()
        ids = automaton.encode(word)
        assert time.perf_counter() - begun < 10
        assert ids == LIBRARY.encode(word, add_special_tokens=False).ids


def test_every_arc_by_its_number(automaton):
    r = random.Random(0)
    tokens = list(automaton.target)
    for _ in range(5_000):
        u, v = r.choice(tokens), r.choice(tokens)
        assert automaton._arc(automaton.target[u], v) == automaton._has_arc(automaton.target[u], v)


def test_a_worker_remembers_little(automaton):
    made = pickle.loads(pickle.dumps(automaton))
    made.remembered = 5_000
    r = random.Random(0)
    texts = [" ".join(f"{r.getrandbits(24):x}" for _ in range(5_000)) for _ in range(8)]
    tracemalloc.start()
    for text in texts:
        made.together([text])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(made.words) + len(made.older) <= 10_000
    assert held < 8e6


def test_long_batches_without_decoding(spark, frame):
    rows = [(i, f"word{i} " * 30_000, "en") for i in range(6)] + [(6, None, "en"), (7, "", "en")]
    with_texts, without = (bpe.encode(frame(rows).coalesce(1), PATH, decode=d).orderBy("doc_id").collect() for d in (True, False))
    assert "decoded" not in without[0] and [r["ids"] for r in without] == [r["ids"] for r in with_texts]
    assert [r["decoded"] for r in with_texts] == [r[1] or "" for r in rows]
    assert without[0]["ids"] == LIBRARY.encode(rows[0][1], add_special_tokens=False).ids
