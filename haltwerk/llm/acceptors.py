"""Minimised acyclic acceptors of word sets, and their composition with a one-edit transducer.

A state is a number; what it accepts from there on is fixed by whether it is
final and by its arcs, so states that accept the same endings are one state
(they are registered by final flag and arcs).  Composing an acceptor with the
transducer that replaces or deletes one letter, and with a second acceptor, gives
states (q, r, edited or not).  Before the edit q and r have read the same
letters; after it both must accept the same ending, which is the common
language of two states.  Both are kept per pair of states, so endings that many
words share are composed once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence


class Acceptors:
    """Acceptors that share their states; state 0 accepts nothing, state 1 the empty word only."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = [{}, {}]
        self.final = [False, True]
        self.register: dict[tuple, int] = {(False,): 0, (True,): 1}
        self.endings: dict[int, list[str]] = {0: [], 1: [""]}
        self.common: dict[tuple[int, int], list[str]] = {}
        self.replaced: dict[int, list[tuple[str, str]]] = {}
        self.deleted: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def state(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, *arcs.items())
        found = self.register.get(key)
        if found is None:
            found = self.register[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return found

    def build(self, words: Sequence[str], at: int = 0) -> int:
        """Initial state of the minimised acceptor of sorted distinct words, read from letter ``at`` on."""
        if not words:
            return 0
        if len(words) == 1:
            state = 1
            for c in reversed(words[0][at:]):
                state = self.state(False, {c: state})
            return state
        final, i, n = len(words[0]) == at, 0, len(words)
        i += final
        arcs = {}
        while i < n:
            c, j = words[i][at], i + 1
            while j < n and words[j][at] == c:
                j += 1
            arcs[c] = self.build(words[i:j], at + 1)
            i = j
        return self.state(final, arcs)

    def language(self, q: int) -> list[str]:
        """All words accepted from a state."""
        found = self.endings.get(q)
        if found is None:
            found = [""] if self.final[q] else []
            for c, t in self.arcs[q].items():
                found += [c + x for x in self.language(t)]
            self.endings[q] = found
        return found

    def shared(self, q: int, r: int) -> list[str]:
        """Words that both states accept."""
        if q == r:
            return self.language(q)
        if q < 2 or r < 2:  # the empty word, or none
            return [""] if q and r and self.final[q] and self.final[r] else []
        key = (q, r) if q < r else (r, q)
        found = self.common.get(key)
        if found is None:
            found = [""] if self.final[q] and self.final[r] else []
            a, b = self.arcs[q], self.arcs[r]
            for c in a.keys() & b.keys():
                x = self.shared(a[c], b[c])
                if x:
                    found += [c + y for y in x]
            self.common[key] = found
        return found

    def one_replaced(self, q: int) -> list[tuple[str, str]]:
        """Pairs of accepted words, each once, that differ in one letter."""
        found = self.replaced.get(q)
        if found is None:
            found = []
            arcs = list(self.arcs[q].items())
            for k, (c, t) in enumerate(arcs):
                if t > 1:
                    found += [(c + v, c + w) for v, w in self.one_replaced(t)]
                for d, u in arcs[:k]:
                    found += [(d + x, c + x) for x in self.shared(t, u)]
            self.replaced[q] = found
        return found

    def one_deleted(self, q: int, r: int) -> list[tuple[str, str]]:
        """Pairs of a word accepted by ``q`` and that word without one letter, accepted by ``r``.

        A pair comes once for each letter of a run that could be the deleted one.
        """
        if not q or not r:
            return []
        found = self.deleted.get((q, r))
        if found is None:
            found = []
            other = self.arcs[r]
            for c, t in self.arcs[q].items():
                found += [(c + x, x) for x in self.shared(t, r)]
                if c in other:
                    found += [(c + v, c + w) for v, w in self.one_deleted(t, other[c])]
            self.deleted[q, r] = found
        return found


LETTERS = 128  # read by one acceptor at most


def near_pairs(long: Sequence[str], short: Sequence[str], start: int) -> list[tuple[str, str]]:
    """Pairs one edit apart among sorted distinct words of one length, and between these and words one letter shorter.

    All words begin with the same ``start`` letters; the edit comes after them.
    Where more than ``LETTERS`` letters follow, the edit is in their first or
    second half: words that share the first half, or else the second, are
    composed on the other half.
    """
    if not long or len(long) + len(short) < 2:
        return []
    end = len(long[0])
    if end - start <= LETTERS:
        machine = Acceptors()
        q, r = machine.build(long, start), machine.build(short, start)
        head = long[0][:start]
        pairs = [(head + v, head + w) for v, w in machine.one_replaced(q)]
        return pairs + [(head + v, head + w) for v, w in set(machine.one_deleted(q, r))]
    middle = (start + end) // 2
    first: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
    second: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
    for which, words in enumerate((long, short)):
        for w in words:
            first[w[:middle]][which].append(w)
            second[w[middle - which :]][which].append(w[: middle - which])
    found = {pair for a, b in first.values() for pair in near_pairs(a, b, middle)}
    found |= {(v + tail, w + tail) for tail, (a, b) in second.items() for v, w in near_pairs(a, b, start)}
    return list(found)
