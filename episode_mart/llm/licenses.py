"""License scan: templates with optional and replaceable regions, compiled into one token automaton.

A template is words, ``<<opt>> ... <<end>>`` for wording that may be left out, and ``<<any:a-b>>`` for
a to b words of any kind. A text is accepted where all mandatory words follow each other exactly. The
automaton is determinised while it runs: a set of template positions becomes one state when first met.

Defined cases: a null or empty text has no words and no labels. Overlapping matches all count. Texts
are read whole; only the ASCII letters A-Z are lower-cased. Columns named like an output are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from episode_mart.llm.common import texts, with_columns

# Phrases whose places are counted, by label.
BASE = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}
TEMPLATES = {
    "apache-2.0": ["apache license <<opt>> version <<end>> 2 0",
                   "you may not use this file except in compliance with the license <<any:0-12>> "
                   "a copy of the license at http www apache org licenses license 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification "
            "are permitted provided that the following conditions are met"],
    "cc-by-nc": ["cc by nc <<opt>> sa <<end>> <<opt>> nd <<end>> <<opt>> <<any:1-1>> 0 <<end>>"],
    "cc-by-nd": ["cc by nd <<opt>> <<any:1-1>> 0 <<end>>"],
    "cc-by-sa": ["cc by sa <<opt>> <<any:1-1>> 0 <<end>>"],
    "cc-by-4.0": ["cc by 4 0", "creative commons attribution 4 0 <<opt>> international <<end>>"],
    "gpl-2.0": ["gnu general public license <<opt>> as published by the free software foundation <<end>> "
                "<<opt>> either <<end>> version 2"],
    "gpl-3.0": ["gnu general public license <<opt>> as published by the free software foundation <<end>> "
                "<<opt>> either <<end>> version 3"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software "
                  "<<any:0-60>> the above copyright notice and this permission notice shall be included in "
                  "all copies <<opt>> or substantial portions of the software <<end>>"],
    "spdx": ["spdx license identifier <<any:1-3>>"],
}

# Words: runs of characters that are neither ASCII punctuation, space nor control characters.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_REGION = re.compile(r"<<(opt|end|any):?(\d*)-?(\d*)>>")
_ANY = None


class Automaton:
    """All templates at once. State 0 is the start; ``accepts`` gives the labels that end in a state."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.steps: list[dict] = []
        self.skips: list[list[int]] = []
        self.ends: dict[int, str] = {}
        start = self._state()
        for label, template in templates:
            first = self._state()
            self.skips[start].append(first)
            last = self._add(first, template)
            self.ends[last] = label
        self.known = {word for step in self.steps for word in step if word is not _ANY}
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.accepts: list[tuple[str, ...]] = []
        self.table: list[dict] = []
        self.start = self._id(self._closure({start}))
        self.first_words = frozenset(w for p in self.sets[self.start] for w in self.steps[p])

    def _state(self) -> int:
        self.steps.append({})
        self.skips.append([])
        return len(self.steps) - 1

    def _add(self, at: int, template: str) -> int:
        opened = []
        for piece in template.split():
            region = _REGION.fullmatch(piece)
            if region is None:
                nxt = self._state()
                self.steps[at].setdefault(piece.encode(), []).append(nxt)
                at = nxt
            elif region[1] == "opt":
                opened.append(at)
            elif region[1] == "end":
                nxt = self._state()
                self.skips[at].append(nxt)
                self.skips[opened.pop()].append(nxt)
                at = nxt
            else:
                fewest, most = int(region[2]), int(region[3])
                may_end = [at] if fewest == 0 else []
                for i in range(1, most + 1):
                    nxt = self._state()
                    self.steps[at].setdefault(_ANY, []).append(nxt)
                    at = nxt
                    if i >= fewest:
                        may_end.append(at)
                nxt = self._state()
                for state in may_end:
                    self.skips[state].append(nxt)
                at = nxt
        return at

    def _closure(self, states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for nxt in self.skips[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)

    def _id(self, states: frozenset) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.accepts.append(tuple(sorted({self.ends[s] for s in states if s in self.ends})))
            self.table.append({})
        return self.ids[states]

    def next(self, state: int, word: bytes) -> int:
        """The next state; the state of the empty set when nothing can follow."""
        if word not in self.known:
            word = _ANY
        found = self.table[state].get(word)
        if found is None:
            targets = set()
            for position in self.sets[state]:
                step = self.steps[position]
                targets.update(step.get(word, ()))
                if word is not _ANY:
                    targets.update(step.get(_ANY, ()))
            found = self.table[state][word] = self._id(self._closure(targets))
        return found

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """(label, first word, word after the last) of the longest match of every label at every place."""
        out = []
        if self.first_words.isdisjoint(words):
            return out
        for at, word in enumerate(words):
            if word not in self.first_words:
                continue
            state, longest = self.start, {}
            for i in range(at, len(words)):
                state = self.next(state, words[i])
                if not self.sets[state]:
                    break
                for label in self.accepts[state]:
                    longest[label] = i + 1
            out.extend((label, at, end) for label, end in sorted(longest.items()))
        return out


def scan(docs: DataFrame, text: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and matches.

    ``score`` is the share of words that lie in a match; ``matches`` lists label:start:end in words.
    """
    chosen = TEMPLATES if templates is None else templates
    flat = [(f"={label}", phrase) for label, phrase in BASE.items()]
    flat += [(label, t) for label, ts in chosen.items() for t in ts]

    def compute():
        automaton = Automaton(flat)

        def one(body: bytes):
            words = _WORD.findall(body.lower())
            found = automaton.matches(words)
            base = [(label[1:], at) for label, at, _ in found if label[0] == "="]
            places = [at for _, at in base]
            covered = set()
            for _, at, end in found:
                covered.update(range(at, end))
            named = [(label.removeprefix("="), at, end) for label, at, end in found]
            return (len(words), len(base), min(places, default=None), max(places, default=None),
                    ",".join(sorted({label for label, _ in base})), ",".join(sorted({n[0] for n in named})),
                    len(covered) / len(words) if words else 0.0,
                    ",".join(f"{label}:{at}:{end}" for label, at, end in named))

        return lambda column: [list(v) for v in zip(*map(one, texts(column)), strict=True)] or [[]] * 8

    return with_columns(docs, text, [
        ("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"),
        ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("matches", "string")], compute)
