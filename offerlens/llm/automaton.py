"""Suffix automaton with occurrence counts over word sequences (part of operator 6)."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


class Automaton:
    """Of all texts added: recognises their substrings and counts where each starts, texts weighted."""

    def __init__(self):
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, words: Sequence[Hashable], weight: int) -> None:
        """Add a text that occurs so many times; substrings do not cross texts."""
        last = 0
        for w in words:
            last = self._step(last, w)
            self.count[last] += weight

    def _state(self, length: int, link: int, nxt: dict) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, q: int, w: Hashable) -> int:
        """The state of the strings of q up to the length of p's step, parted from q if q has longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _step(self, last: int, w: Hashable) -> int:
        if (q := self.next[last].get(w)) is not None:
            return self._split(last, q, w)
        cur, p = self._state(self.length[last] + 1, 0, {}), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p != -1:
            self.link[cur] = self._split(p, self.next[p][w], w)
        return cur

    def close(self) -> None:
        """Carry the counts up the links; call once, after the last text."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.count[self.link[v]] += self.count[v]

    def repeated(self, words: Sequence[Hashable]) -> list[int]:
        """Matching statistics: for each word, how long the longest suffix ending there is that occurs at least twice."""
        out, v, n = [], 0, 0
        for w in words:
            while True:
                to = self.next[v].get(w)
                if to is not None and self.count[to] >= 2:
                    v, n = to, n + 1
                    break
                if v == 0:
                    n = 0
                    break
                v = self.link[v]
                n = self.length[v]
            out.append(n)
        return out
