"""License scan with a generalised suffix automaton.

The automaton holds every factor of every licence template (and of the short
base phrases) as token sequences.  A document is streamed through it once:
after each word the state and match length give the matching statistic, the
longest template factor ending there.  Words of no template reset it, so only
runs of template words are streamed.  Base phrases are the states whose factors
end with the phrase; right-maximal matches of at least ``MIN_MATCH`` words are
chained in document and template order (gap at most ``MAX_GAP`` words) into
spans, and a template whose best chain covers at least ``MIN_COVER`` of its
words adds its label.  The score is the largest share of a template or phrase
that is covered (a base phrase covers itself: 1).

The templates are constants, so the automaton's size is fixed; documents are
scanned where they lie, without any shuffle.

Defined results: null or empty text has no words, no labels and score 0;
repeated rows are scanned one by one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vigil.llm.base import fresh, map_text, query, table
from vigil.llm.text import ALNUM, LOWER, span_hash, word_spans

MIN_MATCH = 6
MAX_GAP = 40
MIN_COVER = 0.6

# Phrases and labels of the base.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Licence texts and notices, public wording, words only.
TEMPLATES = {
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights to
        use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
        software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the software""",
    "apache-2": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the
        license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law
        or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or
        conditions of any kind either express or implied""",
    "cc-by-nc": """this work is licensed under a creative commons attribution noncommercial 4 0 international license to view a copy
        of this license visit http creativecommons org licenses by nc 4 0""",
    "bsd-3-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met redistributions of source code must retain the above copyright notice this list of conditions
        and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of
        conditions and the following disclaimer in the documentation and or other materials provided with the distribution""",
    "gpl": """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
        license as published by the free software foundation""",
    "mpl-2": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at http mozilla org mpl 2 0""",
    "isc": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies""",
}


class Automaton:
    """Generalised suffix automaton over word ids of several sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set] = [set()]
        for s, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c, ends)
                ends[last].add((s, i))
        # every factor's occurrences: those of the states below it in the tree of suffix links
        for v in sorted(range(1, len(self.go)), key=self.length.__getitem__, reverse=True):
            ends[self.link[v]] |= ends[v]
        self.ends = [sorted(e) for e in ends]

    def _state(self, length: int, ends: list) -> int:
        self.go.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append(set())
        return len(self.go) - 1

    def _split(self, p: int, c: int, q: int, ends: list) -> int:
        """The state of p's longest factor followed by c, cut out of q if q has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        new = self._state(self.length[p] + 1, ends)
        self.go[new], self.link[new] = dict(self.go[q]), self.link[q]
        self.link[q] = new
        while p >= 0 and self.go[p].get(c) == q:
            self.go[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int, ends: list) -> int:
        if c in self.go[last]:                      # the factor is known from an earlier sequence
            return self._split(last, c, self.go[last][c], ends)
        new = self._state(self.length[last] + 1, ends)
        p = last
        while p >= 0 and c not in self.go[p]:
            self.go[p][c] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, c, self.go[p][c], ends)
        return new


class Scanner:
    """Automaton, vocabulary and phrase states, built once on the driver."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        texts = [*templates.values(), *phrases]
        self.labels = [*templates, *phrases.values()]
        self.n_templates = len(templates)
        words = sorted({w for t in texts for w in t.split()})
        data = " ".join(words).encode()
        offs = np.array([0, len(data)])
        starts, ends, _ = word_spans(np.frombuffer(data, np.uint8), offs, ALNUM)
        hashes = span_hash(np.frombuffer(data, np.uint8), starts, ends)
        order = np.argsort(hashes)
        self.vocab = hashes[order]
        ids = {words[o]: k + 1 for k, o in enumerate(order.tolist())}
        self.sequences = [[ids[w] for w in t.split()] for t in texts]
        self.sam = Automaton(self.sequences)
        self.shortest = min([len(s) for s in self.sequences[self.n_templates:]] + [MIN_MATCH])
        # phrases ending at a state, by the length the match must have
        own = [[] for _ in self.sam.go]
        for p, seq in enumerate(self.sequences[self.n_templates:]):
            v = 0
            for c in seq:
                v = self.sam.go[v][c]
            own[v].append((len(seq), p + self.n_templates))
        self.phrases = [()] * len(own)
        for v in sorted(range(len(own)), key=self.sam.length.__getitem__):
            up = self.phrases[self.sam.link[v]] if v else ()
            self.phrases[v] = (*up, *own[v])

    def stream(self, ids: list[int]):
        """Phrase places (start, phrase) and right-maximal matches (end, state, length) of one run of template words."""
        go, link, length, phrases = self.sam.go, self.sam.link, self.sam.length, self.phrases
        found, matches = [], []
        v = n = 0
        for i, c in enumerate(ids):
            if c not in go[v]:
                if n >= MIN_MATCH:
                    matches.append((i - 1, v, n))
                while v and c not in go[v]:
                    v = link[v]
                    n = length[v]
            if c in go[v]:
                v, n = go[v][c], n + 1
                for need, p in phrases[v]:
                    if n >= need:
                        found.append((i - need + 1, p))
            else:
                v = n = 0
        if n >= MIN_MATCH:
            matches.append((len(ids) - 1, v, n))
        return found, matches

    def chain(self, matches: list[tuple[int, int, int]]):
        """Best chain per template: (template, first word, last word, share covered), for (end, state, length) of one text."""
        best: dict[int, tuple] = {}
        placed: dict[int, list] = {}
        for end, v, n in matches:
            for t, at in self.sam.ends[v]:
                if t < self.n_templates:
                    placed.setdefault(t, []).append((end, at, n))
        for t, spots in placed.items():
            spots.sort()
            reach: list = []                                    # (end, template end, covered, first word)
            for end, at, n in spots:
                covered, first = n, end - n + 1
                for e, a, c, f in reversed(reach):
                    if e < end - n - MAX_GAP:
                        break
                    gain = min(n, at - a, end - e)              # new words of document and template only
                    if gain > 0 and c + gain > covered:
                        covered, first = c + gain, f
                reach.append((end, at, covered, first))
                share = covered / len(self.sequences[t])
                if t not in best or share > best[t][3]:
                    best[t] = (t, first, end, share)
        return [best[t] for t in sorted(best)]

    def scan(self, buf, offs):
        low = LOWER[buf]
        starts, ends, first = word_spans(low, offs, ALNUM)
        h = span_hash(low, starts, ends)
        at = np.searchsorted(self.vocab, h)
        at[at == len(self.vocab)] = 0
        ids = np.where(self.vocab[at] == h, at + 1, 0) if len(h) else at
        inside = np.r_[False, ids > 0, False]
        row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        cut = np.r_[False, row[1:] != row[:-1], False] if len(row) else np.zeros(1, bool)
        begin = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        stop = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        found, matches = {}, {}
        for a, b in zip(begin.tolist(), stop.tolist()):
            if b - a < self.shortest:
                continue
            places, longest = self.stream(ids[a:b].tolist())
            r = int(row[a])
            base = a - int(first[r])
            if places:
                found.setdefault(r, []).extend((base + s, p) for s, p in places)
            if longest:
                matches.setdefault(r, []).extend((base + e, v, n) for e, v, n in longest)
        return np.diff(first), found, {r: self.chain(m) for r, m in matches.items()}


SPAN = "array<struct<label:string,first_word:long,last_word:long,cover:double>>"


def scan_licenses(docs: DataFrame, keep: list[str], templates: dict[str, str] | None = None,
                  phrases: dict[str, str] | None = None) -> DataFrame:
    """``keep`` plus n_words, n_base, first_word, last_word, base_labels, labels, score, spans (fresh names)."""
    scanner = Scanner(templates or TEMPLATES, phrases or PHRASES)
    shared = docs.sparkSession.sparkContext.broadcast(scanner)       # size fixed by the templates
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("cover", pa.float64())]))

    def kernel(buf, offs):
        s = shared.value
        n_words, found, chains = s.scan(buf, offs)
        rows = len(n_words)
        n_base, first, last = np.zeros(rows, np.int64), [None] * rows, [None] * rows
        base, labels, score, spans = [""] * rows, [""] * rows, np.zeros(rows), [[] for _ in range(rows)]
        for r in found.keys() | chains.keys():
            places = found.get(r, [])
            good = [c for c in chains.get(r, []) if c[3] >= MIN_COVER]
            if places:
                n_base[r], first[r], last[r] = len(places), min(places)[0], max(places)[0]
            own = {s.labels[p] for _, p in places}
            base[r] = ",".join(sorted(own))
            labels[r] = ",".join(sorted(own | {s.labels[c[0]] for c in good}))
            score[r] = 1.0 if places else max((c[3] for c in chains.get(r, [])), default=0.0)
            spans[r] = [{"label": s.labels[t], "first_word": a, "last_word": b, "cover": x} for t, a, b, x in good]
        return [n_words, n_base, pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base, pa.string()),
                pa.array(labels, pa.string()), np.minimum(score, 1.0), pa.array(spans, kind)]
    fields = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"),
              ("labels", "string"), ("score", "double"), ("spans", SPAN)]
    return map_text(docs, kernel, [(fresh(n, keep), t) for n, t in fields], keep)


@query("op6_license_scan")
def license_scan(spark, sf_dir):
    """Licence phrases and templates in every document."""
    return scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])
