"""License scans with template markup compiled into token automata.

A template is a text with two kinds of markup: ``<<optional>>...<</optional>>``
around wording that may be left out, and ``<<any 0-4>>`` for a replaceable region
of so many words.  It is compiled into an automaton over words; a text is accepted
where the mandatory wording stands exactly, word for word, with or without
its optional parts.  Places are found by the first words of the templates, and
every place is run through the automaton of each template that starts so.

Fixed phrases are the base: places where their words stand one after another.

Defined cases: NULL and empty texts have no words, no labels and score 0; equal
rows get equal results; an empty table gives an empty result; other columns are
carried along, those named like a result are replaced.  Texts are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import alnum_words, annotate, quoted

#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label and template.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license <<optional>>version<</optional>> 2.0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is "
                   "distributed on an as is basis without warranties or conditions of any kind"),
    ("mit", "released under the <<optional>>terms of the<</optional>> mit license"),
    ("mit", "licensed under the <<optional>>terms of the<</optional>> mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("gpl-notice", "licensed under the <<optional>>terms of the<</optional>> gnu <<optional>>lesser<</optional>> general "
                   "public license <<optional>>as published by the free software foundation either<</optional>> version <<any 1-2>>"),
    ("gpl-notice", "under the terms of the gnu <<optional>>lesser<</optional>> general public license as published by the "
                   "free software foundation either version <<any 1-2>> of the license or at your option any later version"),
    ("cc-by-nc", "licensed under <<optional>>a<</optional>> cc by nc <<optional>>sa<</optional>> <<optional>>nd<</optional>> <<any 1-2>>"),
    ("cc-by-sa", "licensed under <<optional>>a<</optional>> cc by sa <<any 1-2>>"),
    ("creative-commons", "licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> creative commons "
                         "attribution <<any 0-4>> <<any 1-2>> <<optional>>international<</optional>> license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2.0"),
    ("copyright-notice", "copyright <<optional>>c<</optional>> <<any 1-6>> all rights reserved"),
]
FIELDS = [("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"),
          ("base_labels", "string"), ("labels", "string"), ("score", "double")]
_MARK = re.compile(r"<<(optional|/optional|any (\d+)-(\d+))>>")


class Automaton:
    """States are numbers; ``step[s]`` maps a word to the states after it,
    ``free[s]`` are those after any word, and ``skip[s]`` after none."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.step: list[dict[bytes, set[int]]] = [{}]
        self.free: list[set[int]] = [set()]
        self.skip: list[set[int]] = [set()]
        self.done = [0]  # mandatory words before a state
        at, opened, end = 0, [], 0
        for m in [*_MARK.finditer(template), None]:
            for w in alnum_words(template[end:m.start() if m else None].encode()):
                self.step[at].setdefault(w, set()).add(new := self._state(self.done[at] + (not opened)))
                at = new
            if not m:
                break
            end = m.end()
            if m[1] == "optional":
                opened.append(at)
            elif m[1] == "/optional":
                self.skip[opened.pop()].add(at)
            else:
                low, high = int(m[2]), int(m[3])
                chain = [at]
                for k in range(high):
                    chain.append(self._state(self.done[chain[-1]] + (k < low and not opened)))
                    self.free[chain[-2]].add(chain[-1])
                for s in chain[low:-1]:
                    self.skip[s].add(chain[-1])
                at = chain[-1]
        self.last, self.total = at, self.done[at]
        self.start = self._closed({0})

    def _state(self, done: int) -> int:
        self.step.append({})
        self.free.append(set())
        self.skip.append(set())
        self.done.append(done)
        return len(self.step) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            new = self.skip[todo.pop()] - states
            states |= new
            todo += new
        return states

    def firsts(self) -> set[bytes]:
        return {w for s in self.start for w in self.step[s]}

    def run(self, words: list[bytes], at: int) -> tuple[int, float]:
        """Words matched from ``at`` on (0: not accepted), and the part of the
        mandatory wording that stands there."""
        states, best, matched = self.start, 0, 0
        for i in range(at, len(words)):
            w = words[i]
            states = self._closed({t for s in states for t in self.step[s].get(w, ())} | {t for s in states for t in self.free[s]})
            if not states:
                break
            best = max(best, max(self.done[s] for s in states))
            if self.last in states:
                matched = i + 1 - at
        return matched, 1.0 if matched else min(best / self.total, (self.total - 1) / self.total)


class Scanner:
    def __init__(self, templates=None, phrases=None):
        self.phrases: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for p, label in (phrases or PHRASES).items():
            words = alnum_words(p.encode())
            self.phrases.setdefault(words[0], []).append((words, label))
        self.automata: dict[bytes, list[Automaton]] = {}
        for label, template in templates or TEMPLATES:
            a = Automaton(label, template)
            for w in a.firsts():
                self.automata.setdefault(w, []).append(a)
        self.firsts = frozenset(self.phrases) | frozenset(self.automata)

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str]], float]:
        """Base places (word, label), accepted spans (word, words, label), score."""
        base, spans, score = [], [], 0.0
        for i in [i for i, w in enumerate(words) if w in self.firsts]:
            for p, label in self.phrases.get(words[i], ()):
                if words[i:i + len(p)] == p:
                    base.append((i, label))
            for a in self.automata.get(words[i], ()):
                n, part = a.run(words, i)
                score = max(score, part)
                if n:
                    spans.append((i, n, a.label))
        return base, spans, score


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, templates=None, phrases=None,
         with_spans: bool = False) -> DataFrame:
    """``docs`` with FIELDS; ``with_spans`` adds the accepted places (first word,
    words, label)."""
    fields = FIELDS + ([("spans", "array<struct<word:int,n:int,label:string>>")] if with_spans else [])

    def make():
        scanner = Scanner(templates, phrases)

        def work(cols):
            out = [[] for _ in fields]
            for t in cols[0]:
                words = alnum_words(t)
                base, spans, score = scanner.matches(words)
                own, at = {x for _, x in base}, [i for i, _ in base]
                row = (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)),
                       ",".join(sorted(own | {x for *_, x in spans})), max(score, float(bool(base))),
                       [{"word": i, "n": n, "label": x} for i, n, x in spans])
                for c, v in zip(out, row):
                    c.append(v)
            return out
        return work
    return annotate(docs, [quoted(text)], fields, make, keep)
