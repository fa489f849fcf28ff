"""A trie of letter sequences, walked by a weighted edit automaton.

A walk keeps, for the path so far, a row of distances to each beginning of the
word that is asked for, so words with a common beginning share the work; a
subtree is left when no distance in the row can come down to what the threshold
allows for the longest word below.
"""

from __future__ import annotations

from collections.abc import Iterable

from .hangul import cheap_pairs, letters_of


class LetterTrie:
    def __init__(self, surfaces: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[str]] = [[]]
        self.longest: list[int] = [0]
        self.costs = cheap_pairs()
        for surface in surfaces:
            letters = letters_of(surface)
            at = 0
            self.longest[0] = max(self.longest[0], len(letters))
            for c in letters:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.longest.append(0)
                at = self.children[at][c]
                self.longest[at] = max(self.longest[at], len(letters))
            self.ends[at].append(surface)

    def best(self, word: str, threshold: float, lengths: tuple[int, ...]) -> tuple[str, float] | None:
        """The most similar surface of one of the lengths (in characters) and its similarity, which is at least the threshold; of equals the shorter, then the first by name."""
        own = letters_of(word)
        n, costs, found = len(own), self.costs, None
        stack = [(0, "", [float(i) for i in range(n + 1)], 0)]
        while stack:
            node, letter, above, depth = stack.pop()
            if letter:
                row = [above[0] + 1]
                for j, c in enumerate(own):
                    swap = above[j] if c == letter else above[j] + costs.get((letter, c), 1.0)
                    row.append(min(above[j + 1] + 1, row[j] + 1, swap))
            else:
                row = above
            # 1 - distance / (the longer one's letters) >= threshold
            if min(row) > (1 - threshold) * max(n, self.longest[node]) + 1e-9:
                continue
            for surface in self.ends[node]:
                longer = max(n, depth)
                score = max(0.0, 1 - row[-1] / longer) if longer else 1.0
                if score >= threshold and len(surface) in lengths:
                    rank = (-score, len(surface), surface)
                    if found is None or rank < found:
                        found = rank
            stack += [(child, c, row, depth + 1) for c, child in self.children[node].items()]
        return (found[2], -found[0]) if found else None
