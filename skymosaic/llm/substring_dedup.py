"""Substring dedup by suffix automata: word windows that an earlier document holds are removed.

Reference shards hold the passages that share an anchor (see `repeats`). A shard's suffix automaton is built over its
passages in the order of their documents; a state remembers the first document that reaches it, which is the smallest. The
passages are then streamed through the automaton for their matching statistics, and where a match of `width` words was
first reached by a smaller document than an owner of the passage, the span is removed from that owner; touching spans join
into maximal ones. Shards are routed to the passages they can match instead of being broadcast to all, because all shards
together grow with the corpus.

Cases: null and empty texts have no words; texts shorter than the window keep everything; a document never removes its own
words; rows with one id keep each other's words; a null id counts as the largest; an empty table gives an empty table; other
columns are not read. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Plan, remove

WIDTH, GRAM = 50, 8


class SuffixAutomaton:
    """Suffix automaton of several sequences; `first[s]` is the owner of the first sequence that reached state s."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def _state(self, length: int, first: int, after: dict, link: int = -1) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.length) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        """A state for the shorter strings of q that p leads to."""
        clone = self._state(self.length[p] + 1, self.first[q], dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence, owner: int) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:  # known from an earlier sequence
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, symbol, q)
                continue
            now = self._state(self.length[last] + 1, owner, {})
            p = last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = now
                p = self.link[p]
            if p < 0:
                self.link[now] = 0
            else:
                q = self.next[p][symbol]
                self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
            last = now

    def matches(self, sequence, least: int):
        """(end, first owner of the last `least` symbols) wherever so many match."""
        state, size = 0, 0
        for i, symbol in enumerate(sequence):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                size += 1
            if size >= least:
                while self.length[self.link[state]] >= least:
                    state = self.link[state]
                size = min(size, self.length[state])
                yield i + 1, self.first[state]


def covered(passages: list[bytes], which: np.ndarray, docs: np.ndarray, starts: np.ndarray, width: int):
    """(owner, first window, last window) of what a smaller document holds; owner r holds passage which[r]."""
    first = np.full(len(passages), docs.max(initial=0))
    np.minimum.at(first, which, docs)
    sequences = [p.split(b" ") for p in passages]
    automaton = SuffixAutomaton()
    for i in np.argsort(first, kind="stable").tolist():
        automaton.add(sequences[i], int(first[i]))
    owners = np.argsort(which, kind="stable")
    bounds = np.searchsorted(which[owners], np.arange(len(passages) + 1))
    found = [np.zeros((0, 2), np.int64)]
    for i, sequence in enumerate(sequences):
        mine = owners[bounds[i] : bounds[i + 1]]
        seen = np.array([(end - width, doc) for end, doc in automaton.matches(sequence, width)], np.int64).reshape(-1, 2)
        r, w = np.nonzero(docs[mine][:, None] > seen[None, :, 1])
        found.append(np.stack([mine[r], seen[w, 0]], 1))
    found = np.concatenate(found)
    return found[:, 0], found[:, 1], found[:, 1]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = 1_000) -> DataFrame:
    """See `repeats.remove`; units are words."""
    return remove(docs, Plan(width, gram, True, False, covered, hot), id_col, text_col)


def digest(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return removed.select(id_col, F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
