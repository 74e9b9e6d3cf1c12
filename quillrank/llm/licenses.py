"""License scan: a generalised suffix automaton of license texts.

The automaton holds every word sequence of all templates and phrases. A text is
streamed through it; the state after each word tells the longest sequence of any
template that ends there (the matching statistics). Matches that cannot be made
longer are chained for each template in ascending order of both positions, and
the template words they cover are added up. A template that is covered well
enough gives its label, so reworded and shortened copies are found. Short phrases
are read off the same states: a phrase ends where its own state is on the suffix
path of the current one.

Words outside all templates lead back to the root, so only stretches of template
words are streamed; they are found for a whole block at once.

Defined results: a null text is empty and has no words, labels or places, and
score 0. Rows are scanned one by one; repeated rows and null ids do not matter.
Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillrank.llm.blocks import LOWER, Block, blocks
from quillrank.llm.tables import text_rows

# Phrases with the labels that they must give.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Sentences of public licenses by which their texts are known.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files, to deal in the Software without restriction, including without "
           "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
           "of the Software",
    "mit-name": "released under the MIT License",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except "
                  "in compliance with the License. You may obtain a copy of the License at",
    "apache-name": "licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted "
           "provided that the following conditions are met",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the "
                  "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
                  "License, or (at your option) any later version",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
               "the MPL was not distributed with this file, You can obtain one at",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
           "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
                 "modify, publish, use, compile, sell, or distribute this software",
}

LABELS = {
    "mit": "mit", "mit-name": "mit", "apache-2.0": "apache-2.0", "apache-name": "apache-2.0", "bsd": "bsd",
    "gpl-notice": "gpl", "mpl-2.0": "mpl-2.0", "isc": "isc", "unlicense": "unlicense",
}

_INSIDE = np.ones(256, bool)
_INSIDE[: 128] = [chr(i).isalnum() for i in range(128)]
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class LicenseConfig:
    """``least``: words of a long match. ``coverage``: part of a template that must be covered.

    ``gap`` is the most words that may lie between two matches of a chain.
    Templates of at most ``whole`` words count only if all their words stand in a row.
    """

    least: int = 3
    coverage: float = 0.6
    gap: int = 40
    whole: int = 10


def words_of(text: str) -> list[str]:
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


class LicenseAutomaton:
    """Suffix automaton of all templates and phrases, words as numbers; built once per task."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES,
                 whole: int = LicenseConfig.whole):
        self.names = list(templates)
        self.sizes = {n: len(words_of(t)) for n, t in templates.items()}
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in [*templates.values(), *phrases] for w in words_of(t)}))}
        joined = " ".join(self.vocabulary).encode()
        block = Block(0, np.array([0, len(joined)]), np.frombuffer(joined, np.uint8))
        starts, ends, _ = block.tokens(_INSIDE[block.data])
        prints = block.hashes(starts, ends)
        order = np.argsort(prints)
        self.prints, self.numbers = prints[order], order
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[str, int]]] = [[]]
        for name, text in templates.items():
            self._add(name, [self.vocabulary[w] for w in words_of(text)])
        for phrase in phrases:
            self._add("", [self.vocabulary[w] for w in words_of(phrase)])
        self._spread_ends()
        self.phrase_at: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for phrase, label in phrases.items():
            ids, state = [self.vocabulary[w] for w in words_of(phrase)], 0
            for i in ids:
                state = self.next[state][i]
            self.phrase_at[state].append((len(ids), label))
        self.short = {n for n, size in self.sizes.items() if size <= whole}
        self.short_at: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for name in sorted(self.short):
            ids, state = [self.vocabulary[w] for w in words_of(templates[name])], 0
            for i in ids:
                state = self.next[state][i]
            self.short_at[state].append((len(ids), name))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.phrase_at[state] = self.phrase_at[state] + self.phrase_at[self.link[state]]
            self.short_at[state] = self.short_at[state] + self.short_at[self.link[state]]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A state of its own for the strings of ``target`` that extend ``state``."""
        copy = self._state(self.length[state] + 1)
        self.next[copy] = dict(self.next[target])
        self.link[copy] = self.link[target]
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _add(self, name: str, ids: list[int]) -> None:
        last = 0
        for place, word in enumerate(ids):
            known = self.next[last].get(word)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
            else:
                fresh, state = self._state(self.length[last] + 1), last
                while state >= 0 and word not in self.next[state]:
                    self.next[state][word] = fresh
                    state = self.link[state]
                if state >= 0:
                    target = self.next[state][word]
                    exact = self.length[target] == self.length[state] + 1
                    self.link[fresh] = target if exact else self._split(state, word, target)
                last = fresh
            if name:
                self.ends[last].append((name, place))

    def _spread_ends(self) -> None:
        """Every state ends where the states that have it as suffix end; templates are short."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] = list({*self.ends[self.link[state]], *self.ends[state]})

    def number(self, prints: np.ndarray) -> np.ndarray:
        """Numbers of words by their hashes, -1 for words outside all templates."""
        at = np.minimum(np.searchsorted(self.prints, prints), len(self.prints) - 1)
        return np.where(self.prints[at] == prints, self.numbers[at], -1)

    def stream(self, ids: list[int], first: int, least: int):
        """Matching statistics of a stretch of words: phrase places and maximal matches.

        Places are (start, label). Matches are (start, length, [(template, start there)]).
        """
        following, link, length = self.next, self.link, self.length
        places: list[tuple[int, str]] = []
        matches: list[tuple[int, int, list[tuple[str, int]]]] = []
        state, size, before = 0, 0, (0, 0)
        for i, word in enumerate(ids):
            while state and word not in following[state]:
                state = link[state]
                size = length[state]
            state = following[state].get(word, 0)
            size = size + 1 if state else 0
            if size != before[1] + 1 and before[1] >= least:
                self._record(matches, before, first + i)
            before = (state, size)
            for n, label in self.phrase_at[state]:
                if n <= size:
                    places.append((first + i + 1 - n, label))
            for n, name in self.short_at[state]:
                if n <= size:
                    matches.append((first + i + 1 - n, n, [(name, 0)]))
        if before[1] >= least:
            self._record(matches, before, first + len(ids))
        return places, matches

    def _record(self, matches: list, found: tuple[int, int], stop: int) -> None:
        state, size = found
        where = [(name, place + 1 - size) for name, place in self.ends[state] if name not in self.short]
        if where:
            matches.append((stop - size, size, where))

    def covered(self, matches: list, cfg: LicenseConfig) -> dict[str, tuple[float, int, int]]:
        """For each template the best chain: covered part, first word and end of its span in the text."""
        by_name: dict[str, list[tuple[int, int, int]]] = {}
        for start, size, where in matches:
            for name, place in where:
                by_name.setdefault(name, []).append((start, place, size))
        best: dict[str, tuple[float, int, int]] = {}
        for name, parts in by_name.items():
            parts.sort()
            total = self.sizes[name]
            chains: list[tuple[int, int, int, int]] = []  # covered words, text start, text end, template end
            for start, place, size in parts:
                gain = (size, start, start + size, place + size)
                # Earlier parts beyond the gap cannot be followed; the list is in text order.
                for words, begin, stop, end in reversed(chains):
                    if start - stop > cfg.gap + total:
                        break
                    # Overlaps, in the text or the template, count once.
                    over = max(stop - start, end - place, 0)
                    if over < size and start - stop <= cfg.gap and words + size - over > gain[0]:
                        gain = (words + size - over, begin, start + size, place + size)
                chains.append(gain)
                found = (min(1.0, gain[0] / total), gain[1], gain[2])
                if found[0] > best.get(name, (0.0,))[0]:
                    best[name] = found
        return best


def scan_licenses(documents: DataFrame, cfg: LicenseConfig = LicenseConfig(), templates: dict[str, str] = TEMPLATES,
                  label_of: dict[str, str] = LABELS) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` for every row.

    ``n_base``: places of the phrases; ``first_word, last_word``: their smallest and
    largest start. ``labels`` adds those of the templates covered by ``coverage`` at
    least; ``spans`` has their places as words from and to. ``score`` is the best
    covered part of any template, or 1 if there is a phrase.
    """
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("stop", pa.int64()), ("covered", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LicenseAutomaton(templates, whole=cfg.whole)
        for batch in batches:
            for block in blocks(batch.column("text")):
                folded = Block(block.first, block.offsets, LOWER[block.data])
                starts, ends, first = folded.tokens(_INSIDE[folded.data])
                ids = automaton.number(folded.hashes(starts, ends))
                owner = np.repeat(np.arange(block.n), np.diff(first))
                # Stretches of two template words or more, within one text.
                inside = ids >= 0
                joined = np.zeros(len(ids) + 1, bool)
                joined[1:-1] = inside[1:] & inside[:-1] & (owner[1:] == owner[:-1])
                begin = np.flatnonzero(joined[1:] & ~joined[:-1])
                stop = np.flatnonzero(joined[:-1] & ~joined[1:]) + 1
                places: dict[int, list] = {}
                matches: dict[int, list] = {}
                for a, b in zip(begin.tolist(), stop.tolist()):
                    i = int(owner[a])
                    p, m = automaton.stream(ids[a:b].tolist(), a - int(first[i]), cfg.least)
                    if p:
                        places.setdefault(i, []).extend(p)
                    if m:
                        matches.setdefault(i, []).extend(m)
                base = [places.get(i, []) for i in range(block.n)]
                spans, scores, labels = [], [], []
                for i in range(block.n):
                    best = automaton.covered(matches[i], cfg) if i in matches else {}
                    spans.append([
                        {"label": label_of[k], "first": v[1], "stop": v[2], "covered": v[0]}
                        for k, v in sorted(best.items()) if v[0] >= cfg.coverage
                    ])
                    scores.append(max([0.0, *(v[0] for v in best.values()), *(1.0 for _ in base[i][:1])]))
                    labels.append(",".join(sorted({label for _, label in base[i]} | {s["label"] for s in spans[-1]})))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id")[block.first : block.first + block.n],
                    "n_words": np.diff(first).astype(np.int64), "n_base": pa.array([len(b) for b in base], pa.int64()),
                    "first_word": pa.array([min(b)[0] if b else None for b in base], pa.int64()),
                    "last_word": pa.array([max(b)[0] if b else None for b in base], pa.int64()),
                    "base_labels": pa.array([",".join(sorted({label for _, label in b})) for b in base], pa.string()),
                    "labels": pa.array(labels, pa.string()), "score": pa.array(scores, pa.float64()),
                    "spans": pa.array(spans, pa.list_(span)),
                })

    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double, spans array<struct<label: string, first: long, stop: long, covered: double>>")
    return text_rows(documents).mapInArrow(run, schema)
