"""A generalised suffix automaton over the words of several items, for use inside tasks."""

from __future__ import annotations

from itertools import repeat

import numpy as np

#: bytes.translate table: A-Z in lower case, digits, a-z and all bytes of non-ASCII letters as they are, else a space.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of digits, a-z (A-Z lower-cased) and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class SuffixAutomaton:
    """All word sequences inside the items. A state stands for the sequences that end at the same places.

    trans maps state * n_vocab + word to a state; link is the state of the longest proper suffix that is in another
    state; longest is the length of a state's longest sequence.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        coded = [(key, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for key, words in items if words]
        self.n_vocab = max(1, len(self.vocab))
        self.trans: dict[int, int] = {}
        self.out: list[list[int]] | None = [[]]
        self.link, self.longest = [-1], [0]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.out = None
        #: items that hold the state's sequences of `window` words; whole items of fewer words, by state
        self.items_of: dict[int, list] = {}
        self.short_at: dict[int, list[tuple[int, object]]] = {}
        seen: dict[int, int] = {}
        for number, (key, words) in enumerate(coded):
            state = 0
            for place, w in enumerate(words):
                state = self.trans[state * self.n_vocab + w]
                if place + 1 >= window:
                    at = self._of_window(state)
                    if seen.get(at) != number:
                        seen[at] = number
                        self.items_of.setdefault(at, []).append(key)
            if len(words) < window:
                self.short_at.setdefault(state, []).append((len(words), key))
        self.least = min([window, *(n for x in self.short_at.values() for n, _ in x)]) if coded else window
        # the nearest state at or above each one at which short items end
        self.short_from = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.longest.__getitem__):
            self.short_from[state] = state if state in self.short_at else self.short_from[self.link[state]] if self.link[state] > 0 else -1

    def _extend(self, last: int, w: int) -> int:
        trans, link, longest, v = self.trans, self.link, self.longest, self.n_vocab
        there = trans.get(last * v + w)
        if there is not None:
            return there if longest[there] == longest[last] + 1 else self._split(last, w, there)
        new = len(link)
        link.append(0)
        longest.append(longest[last] + 1)
        self.out.append([])
        at = last
        while at >= 0 and at * v + w not in trans:
            trans[at * v + w] = new
            self.out[at].append(w)
            at = link[at]
        if at >= 0:
            there = trans[at * v + w]
            link[new] = there if longest[there] == longest[at] + 1 else self._split(at, w, there)
        return new

    def _split(self, at: int, w: int, there: int) -> int:
        """A copy of `there` for its sequences of up to longest[at] + 1 words."""
        trans, link, longest, v = self.trans, self.link, self.longest, self.n_vocab
        copy = len(link)
        link.append(link[there])
        longest.append(longest[at] + 1)
        self.out.append(list(self.out[there]))
        for x in self.out[there]:
            trans[copy * v + x] = trans[there * v + x]
        link[there] = copy
        while at >= 0 and trans.get(at * v + w) == there:
            trans[at * v + w] = copy
            at = link[at]
        return copy

    def _of_window(self, state: int) -> int:
        """The state of the last `window` words of a state's sequence."""
        while self.longest[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def matches(self, words: list[bytes]) -> tuple[list[list[int]], set, int]:
        """([start, end) word spans that windows cover, in order and apart; keys of items with occurring windows;
        length of the longest match)."""
        spans: list[list[int]] = []
        keys: set = set()
        best = 0
        if len(words) < self.least or not self.trans:
            return spans, keys, best
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        trans, link, longest, v, window = self.trans, self.link, self.longest, self.n_vocab, self.window
        for start, end in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if end - start < self.least:  # too short for any window
                continue
            state = length = 0
            for i, w in enumerate(ids[start:end].tolist(), start):
                to = trans.get(state * v + w)
                if to is None:
                    while state > 0 and to is None:
                        state = link[state]
                        to = trans.get(state * v + w)
                    length = longest[state]
                    if to is None:  # a known word leaves the root at least
                        state = length = 0
                        continue
                state = to
                length += 1
                if length > best:
                    best = length
                covered = 0
                if length >= window:
                    keys.update(self.items_of[self._of_window(state)])
                    covered = window
                at = self.short_from[state]
                while at > 0:
                    for n, key in self.short_at[at]:
                        if n <= length:
                            keys.add(key)
                            covered = max(covered, n)
                    above = link[at]
                    at = self.short_from[above] if above > 0 else -1
                if covered:
                    first = i + 1 - covered
                    while spans and spans[-1][0] >= first:
                        spans.pop()
                    if spans and spans[-1][1] >= first:
                        spans[-1][1] = i + 1
                    else:
                        spans.append([first, i + 1])
        return spans, keys, best
