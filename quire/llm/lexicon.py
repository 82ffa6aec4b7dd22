"""A lexicon trie intersected with Levenshtein automata, determinised as it is used.

A state is the set of (trie node, edits so far) that some reading of the letters so
far can be in, with the fewest edits kept per node. Transitions are worked out once and
remembered, so a word costs one table lookup per letter and most words end in the dead
state after a few. How many edits a term allows grows with its length; a stem stands
for every word that begins with it, or within its edits of it where stems are given any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

State = tuple[tuple[int, int], ...]


def edits_allowed(term: str) -> int:
    """Short terms lie within an edit of too many other words."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


def stem_edits_allowed(stem: str) -> int:
    """A stem's second edit would make it one of two letters less."""
    return min(1, edits_allowed(stem))


def no_edits(stem: str) -> int:
    return 0


class Matcher:
    #: States remembered, and places in them, before the table starts anew.
    MOST_STATES = 50_000
    MOST_PLACES = 1_000_000

    def __init__(self, terms: Iterable[str], stems: Iterable[str] = (), stem_edits: Callable[[str], int] = no_edits):
        self.stem_edits = stem_edits
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.allowed = [0]  # the most edits of any term below
        for words, ends, edits in ((set(terms), self.term, edits_allowed), (set(stems), self.stem, stem_edits)):
            for word in sorted(words):
                node, k = 0, edits(word)
                self.allowed[0] = max(self.allowed[0], k)
                for letter in word:
                    if letter not in self.children[node]:
                        self.children[node][letter] = len(self.children)
                        self.children.append({})
                        self.term.append(None)
                        self.stem.append(None)
                        self.allowed.append(0)
                    node = self.children[node][letter]
                    self.allowed[node] = max(self.allowed[node], k)
                ends[node] = word
        self._forget()

    def _forget(self) -> None:
        self.number: dict[State, int] = {(): 0}
        self.states: list[State] = [()]
        self.moves: list[dict[str, int]] = [{}]
        self.stemmed: list[tuple[int, str] | None] = [None]
        self.places = 0
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a state after letters have been skipped where edits allow it."""
        work = list(nodes.items())
        while work:
            node, e = work.pop()
            if nodes[node] < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.allowed[child] and nodes.get(child, 99) > e + 1:
                    nodes[child] = e + 1
                    work.append((child, e + 1))
        state = tuple(sorted(nodes.items()))
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.places += len(state)
            begun = ((e, self.stem[n]) for n, e in state if self.stem[n])
            self.stemmed.append(min((x for x in begun if x[0] <= self.stem_edits(x[1])), default=None))
        return self.number[state]

    def _move(self, state: int, letter: str) -> int:
        nodes: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.allowed[node] and nodes.get(node, 99) > e:
                nodes[node] = e

        for node, e in self.states[state]:
            reach(node, e + 1)  # a letter too many
            for x, child in self.children[node].items():
                reach(child, e + (x != letter))
        self.moves[state][letter] = to = self._state(nodes)
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of ``nearest``."""
        found = self.nearest(word)
        return found and found[:2]

    def nearest(self, word: str) -> tuple[str, int, int] | None:
        """(term, edits, letters of the word that it takes) of the term that is the word, else of the
        longest stem that begins it, else of the nearest term, else stem; a stem takes the shortest beginning as near."""
        if len(self.states) > self.MOST_STATES or self.places > self.MOST_PLACES:
            self._forget()
        at, moves, stemmed = self.start, self.moves, self.stemmed
        begun, taken = None, 0
        for n, letter in enumerate(word, 1):
            to = moves[at].get(letter)
            if to is None:
                to = self._move(at, letter)
            at = to
            if not at:
                break
            if stemmed[at] and (begun is None or stemmed[at][0] < begun[0] or not stemmed[at][0]):
                begun, taken = stemmed[at], n
        if begun and not begun[0]:
            exact = (self.term[n] for n, e in self.states[at] if not e and self.term[n])
            return next(((t, 0, len(word)) for t in exact), (begun[1], 0, taken))
        best = None
        for node, e in self.states[at]:
            term = self.term[node]
            if term is not None and e <= edits_allowed(term) and (best is None or e < best[1]):
                best = (term, e, len(word))
        if begun and (best is None or begun[0] < best[1]):
            return begun[1], begun[0], taken
        return best
