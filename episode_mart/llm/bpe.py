"""Byte-level BPE by a tokenization automaton.

The automaton reads tokens and accepts exactly the sequences that the merges produce. It starts as one
state with an arc for every byte. Each merge (u, v) adds a gadget: wherever u may be followed by v, u now
leads to a copy of its target without the arc v, and a new arc uv leads on to where v led. As the
target of an arc depends on its label alone, the whole automaton is a tree of states, each of which is
another state less one arc, and a target per token. Its transition table is filled as words need it.

Pre-split words are encoded by walking the automaton along the word's bytes, longest arc first; the
accepted path is unique, so a place from which the word cannot be finished is left for good. Decoding
emits the labels of the arcs, which are the tokens' bytes. Texts are taken together up to ``CHUNK`` bytes: their
words are numbered, each different word is walked (or looked up) once, and its tokens are gathered for all
its places in Arrow, as the labels are for all tokens. Walked words are remembered in two generations, so frequent ones
stay. What a worker holds beside its Arrow batch and the automaton is bounded by ``CHUNK``, or one text, and by the words and
arcs that it remembers (``CACHED``, ``TABLED``). The path of the vocabulary file is a
parameter; the driver reads it and sends the compiled automaton (its size is the vocabulary's) to the tasks.

Defined cases: null and empty texts have no tokens and decode to the empty text. Special tokens of the
file are recognised in texts. Repeated rows get equal results. Columns named like an output are replaced.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episode_mart.llm.common import map_batches

# Fixed value: the pre-splitting pattern of byte-level vocabularies.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED = 200_000
TABLED = 250_000
CHUNK = 1 << 19
PREFIX = 5

_TOKEN = np.dtype("int32")


def _packed(tokens: list[int]) -> bytes:
    return array("i", tokens).tobytes()


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in prints}
    hidden = [b for b in range(256) if b not in set(prints)]
    letters.update({chr(256 + i): b for i, b in enumerate(hidden)})
    return letters


class TokenAutomaton:
    """Compiled merges. ``labels`` are the arcs' bytes by token, ``tokens`` the tokens by bytes."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int]):
        self.special = special
        self.labels = {t: b for b, t in vocabulary.items()}
        self.parent, self.lacks, self.since = array("i", [0]), array("i", [-1]), array("i", [-1])  # state 0 lacks nothing
        self.target = {vocabulary[bytes([b])]: 0 for b in range(256) if bytes([b]) in vocabulary}
        self.left, self.made = (array("i", [-1]) * (max(vocabulary.values(), default=-1) + 1) for _ in range(2))  # -1: no merge
        for time, (u, v) in enumerate(merges):
            self._gadget(time, vocabulary[u], vocabulary[v], vocabulary[u + v])
        self.tokens = {self.labels[t]: t for t in self.target}
        # longest token by its first PREFIX bytes; where they begin none, tokens are shorter
        self.reach: dict[bytes, int] = {}
        for b in self.tokens:
            if len(b) >= PREFIX:
                self.reach[b[:PREFIX]] = max(self.reach.get(b[:PREFIX], 0), len(b))
        self.labels.update({t: s.encode() for s, t in special.items()})
        self._index()
        self._start()

    def _gadget(self, time: int, u: int, v: int, uv: int) -> None:
        if u not in self.target or v not in self.target or not self._has_arc(self.target[u], v):
            return  # no path reads u and then v, so nothing is replaced
        onwards = self.target[v]
        self.parent.append(self.target[u])
        self.lacks.append(v)
        self.since.append(time)
        self.target[u] = len(self.parent) - 1
        if uv not in self.target:
            self.target[uv], self.left[uv], self.made[uv] = onwards, u, time

    def _has_arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow: an arc uv was added where an arc u was left by that merge."""
        before = {token: len(self.parent) + len(self.target)}
        while self.left[token] >= 0:
            made = self.made[token]
            token = self.left[token]
            before.setdefault(token, made)
        while state:
            if self.since[state] <= before.get(self.lacks[state], -1):
                return False
            state = self.parent[state]
        return True

    def _index(self) -> None:
        """Number the tree of states so that a state's descendants are a range, and list by arc who lacks it.

        No two states on a way to the root lack the same arc, so the ranges of one arc are disjoint.
        """
        n = len(self.parent)
        size = [1] * n
        for state in range(n - 1, 0, -1):  # parents come before children
            size[self.parent[state]] += size[state]
        self.first, free = array("i", [0]) * n, [1] * n
        for state in range(1, n):
            above = self.parent[state]
            self.first[state] = self.first[above] + free[above]
            free[above] += size[state]
        self.lacking: dict[int, tuple[array, array, array]] = {}
        for state in sorted(range(1, n), key=self.first.__getitem__):
            begins, ends, since = self.lacking.setdefault(self.lacks[state], (array("i"), array("i"), array("i")))
            begins.append(self.first[state])
            ends.append(self.first[state] + size[state])
            since.append(self.since[state])

    def _arc(self, state: int, token: int) -> bool:
        """``_has_arc`` of the finished automaton, by the numbering."""
        at, before = self.first[state], len(self.parent) + len(self.target)
        while True:
            found = self.lacking.get(token)
            if found is not None:
                i = bisect_right(found[0], at) - 1
                if i >= 0 and at < found[1][i] and found[2][i] <= before:
                    return False
            if self.left[token] < 0:
                return True
            made = self.made[token]
            before = made if made < before else before
            token = self.left[token]

    def _start(self) -> None:
        self.remembered: int | None = None
        self.table: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.by_token = pa.array([self.labels.get(t, b"") for t in range(max(self.labels, default=-1) + 1)], pa.large_binary())
        self.split = regex.compile(PRE_SPLIT)
        names = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, names))) if names else None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("remembered", "table", "words", "older", "by_token", "split", "specials")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _follows(self, token: int, after: int) -> bool:
        state = self.target[after]
        key = state << 32 | token
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= TABLED:
                self.table.clear()
            found = self.table[key] = self._arc(state, token)
        return found

    def path(self, word: bytes) -> list[int]:
        """The accepted path that spells ``word``."""
        tokens, reach = self.tokens, self.reach
        whole = tokens.get(word)
        if whole is not None:  # the longest arc of all
            return [whole]
        n = len(word)
        dead = bytearray(n + 1)
        path: list[int] = []
        at, end = 0, min(n, reach.get(word[:PREFIX], PREFIX - 1))
        while at < n:
            token = None
            while end > at:
                token = tokens.get(word[at:end])
                if token is not None and not dead[end] and (not path or self._follows(token, path[-1])):
                    break
                token = None
                end -= 1
            if token is not None:
                path.append(token)
                at, end = end, min(n, end + reach.get(word[end:end + PREFIX], PREFIX - 1))
            elif path:
                dead[at] = 1
                end = at - 1
                at -= len(self.labels[path.pop()])
            else:
                raise ValueError(f"no path spells {word!r}")
        return path

    def word(self, word: str) -> bytes:
        """Tokens of a pre-split word, as 32-bit integers: bytes are the least of what may remember them."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= (self.remembered or CACHED):
                self.words, self.older = {}, self.words
            found = self.older.get(word)
            if found is None:
                found = _packed(self.path(word.encode()))
            self.words[word] = found
        return found

    def _plain(self, text: str) -> list[bytes]:
        return [self.word(w) for w in self.split.findall(text)]

    def pieces(self, text: str) -> list[bytes]:
        """Tokens of every pre-split word and special token."""
        if self.specials is None or not self.specials.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [*self._plain(text[at:m.start()]), _packed([self.special[m[0]]])]
            at = m.end()
        return out + self._plain(text[at:])

    def tokens_of(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Tokens of all texts, with the end of every text's part."""
        words, ends, own = [], np.zeros(len(texts), "int64"), []
        for i, text in enumerate(texts):
            if self.specials is not None and self.specials.search(text):
                pieces = self.pieces(text)
                own += pieces
                words += [None] * len(pieces)
            else:
                words += self.split.findall(text)
            ends[i] = len(words)
        numbered = pa.array(words, pa.string()).dictionary_encode()
        del words
        known = [self.word(w) for w in numbered.dictionary.to_pylist()]
        at = np.asarray(numbered.indices.fill_null(-1)).copy()
        at[at < 0] = np.arange(len(known), len(known) + len(own))  # pieces with special tokens stand for themselves
        known += own
        lengths = np.fromiter(map(len, known), "int64", len(known)) // _TOKEN.itemsize
        lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(lengths)].astype("int32"), np.frombuffer(b"".join(known), _TOKEN))
        lists = lists.take(pa.array(at))
        by_word = np.r_[0, np.cumsum(np.asarray(pc.list_value_length(lists)), dtype="int64")]
        return lists.flatten(), by_word[ends]

    def labels_of(self, tokens: pa.Array, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Labels (bytes) of the tokens of all texts, with the end of every text's part."""
        labels = self.by_token.take(tokens)
        by_token = np.r_[0, np.cumsum(np.asarray(pc.binary_length(labels)), dtype="int64")]
        return labels, by_token[ends]

    def together(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
        """Tokens and labels of all texts, each with the end of every text's part."""
        tokens, ends = self.tokens_of(texts)
        return tokens, ends, *self.labels_of(tokens, ends)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.pieces(text)), _TOKEN).tolist()

    def decode(self, tokens: list[int]) -> str:
        return b"".join([self.labels[t] for t in tokens]).decode(errors="replace")


def compile_file(path: str) -> TokenAutomaton:
    """The automaton of a byte-level vocabulary file (JSON with model.vocab, model.merges, added_tokens)."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    special = {}
    for t in content.get("added_tokens", []):
        if t.get("lstrip") or t.get("rstrip") or t.get("single_word"):
            raise ValueError(f"token with unsupported options: {t['content']}")
        special[t["content"]] = t["id"]
    letters = byte_letters()

    def spelled(name: str) -> bytes:
        return bytes(letters[c] for c in name)

    model = content["model"]
    vocabulary = {spelled(k): v for k, v in model["vocab"].items() if k not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return TokenAutomaton(vocabulary, [(spelled(u), spelled(v)) for u, v in merges], special)


_SHARED: dict = {}


def _shared(spark: SparkSession, path: str):
    """The broadcast automaton, compiled once per session and file."""
    key = spark.sparkContext.applicationId, path
    if key not in _SHARED:
        _SHARED.clear()
        _SHARED[key] = spark.sparkContext.broadcast(compile_file(path))
    return _SHARED[key]


def _texts_of(labels: pa.Array, ends: np.ndarray) -> pa.Array:
    """The labels up to each end, joined, as text; bytes that are no UTF-8 are replaced."""
    joined = labels.buffers()[2] or pa.py_buffer(b"")  # gathered one behind the other
    parts = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype("int64")), joined])
    try:
        return parts.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([b.decode(errors="replace") for b in parts.to_pylist()], pa.string())


def encode(docs: DataFrame, path: str, text: str = "text", decode: bool = True, remembered: int | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and, with ``decode``, ``decoded``, the text that the ids decode to.

    A worker remembers up to twice ``remembered`` words (``CACHED``): fewer take less memory and more time.
    """
    new = {"ids": T.ArrayType(T.IntegerType())} | ({"decoded": T.StringType()} if decode else {})
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, t) for c, t in new.items()]])
    at, names = kept.columns.index(text), schema.names
    shared = _shared(docs.sparkSession, path)

    def encoded(automaton: TokenAutomaton, part: pa.RecordBatch) -> pa.RecordBatch:
        ids, ends = automaton.tokens_of([body or "" for body in part.column(at).to_pylist()])
        columns = [*part.columns, pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), ids)]
        if decode:
            columns.append(_texts_of(*automaton.labels_of(ids, ends)))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        automaton = shared.value
        automaton.remembered = remembered
        for batch in batches:
            ends = np.cumsum(np.asarray(pc.binary_length(batch.column(at)).fill_null(0)), dtype="int64")
            begin = 0
            while begin < len(ends):
                done = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
                yield encoded(automaton, batch.slice(begin, end - begin))
                begin = end
            del batch  # or it would lie beside the next one

    return map_batches(kept, run, schema)
