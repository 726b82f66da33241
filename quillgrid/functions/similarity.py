"""Best matches of short texts among a bounded list of titles, by matching blocks, shared tokens and coverage."""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np

# The weights of matching blocks, token cosine and coverage, of a match with the text of ancestors, and the least score.
BLOCKS, COSINE, COVERAGE, ANCESTORS, LEAST = 0.35, 0.35, 0.30, 0.85, 0.05
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letter_counts(text: str) -> np.ndarray:
    found = Counter(text)
    return np.array([found.get(c, 0) for c in LETTERS], np.int16)


class Side:
    """One text of every title: what bounds and measures its likeness to a phrase."""

    def __init__(self, texts: list[str], tokens: list[list[str]]):
        self.texts = texts
        self.length = np.array([len(t) for t in texts], np.int64)
        self.letters = np.stack([letter_counts(t) for t in texts]) if texts else np.zeros((0, len(LETTERS)), np.int16)
        self.norm = np.sqrt(np.array([sum(n * n for n in Counter(own).values()) for own in tokens], np.float64))
        self.has: dict[str, tuple[list[int], list[int]]] = {}
        for i, own in enumerate(tokens):
            for token, n in Counter(own).items():
                at, times = self.has.setdefault(token, ([], []))
                at.append(i)
                times.append(n)
        self.blocks: dict[int, SequenceMatcher] = {}

    def at_most(self, phrase: str) -> np.ndarray:
        """No less than ratio() of every text: letters in common, wherever they stand."""
        common = np.minimum(self.letters, letter_counts(phrase)).sum(axis=1)
        return np.where(self.length > 0, 2.0 * common / np.maximum(self.length + len(phrase), 1), 0.0)

    def ratio(self, phrase: str, i: int) -> float:
        """Twice the letters in matching blocks over all letters: the longest common block, then the same on either side of it."""
        if not phrase or not self.texts[i]:
            return 0.0
        blocks = self.blocks.get(i)
        if blocks is None:
            blocks = self.blocks[i] = SequenceMatcher(None, "", self.texts[i])
        blocks.set_seq1(phrase)
        return blocks.ratio()

    def cosine(self, tokens: list[str]) -> np.ndarray:
        dot = np.zeros(len(self.texts))
        mine = Counter(tokens)
        for token, n in mine.items():
            at, times = self.has.get(token, ([], []))
            dot[at] += n * np.array(times)
        norm = self.norm * np.sqrt(float(sum(n * n for n in mine.values())))
        return np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)

    def shared(self, tokens: set[str]) -> np.ndarray:
        n = np.zeros(len(self.texts))
        for token in tokens:
            n[self.has.get(token, ([], []))[0]] += 1
        return n


@dataclass
class Titles:
    """Titles in the order that decides between equal scores."""

    own: Side
    around: Side

    #: Pairs of phrase and title met, and those of them that were measured exactly.
    met: int = 0
    measured: int = 0

    def best(self, phrases: list[tuple[str, list[str]]], most: int) -> list[tuple[float, int]]:
        """The most best titles, as score and place, for phrases given as text and tokens; scores are rounded to 9 places.

        Every title is bounded first; exact measures start with the highest bound and end as no bound is left that
        could still come in, so the result is that of measuring all.
        """
        parts = []
        for text, tokens in phrases:
            if not text:
                continue
            mine = set(tokens)
            rest = COSINE * np.maximum(self.own.cosine(tokens), self.around.cosine(tokens)) + COVERAGE * (self.own.shared(mine) / max(len(mine), 1))
            parts.append((text, rest, rest + BLOCKS * np.maximum(self.own.at_most(text), ANCESTORS * self.around.at_most(text))))
        if not parts:
            return []
        bounds = np.max([bound for _, _, bound in parts], axis=0)
        self.met += len(parts) * len(bounds)
        held: list[tuple[float, int]] = []
        for i in np.argsort(-bounds, kind="stable").tolist():
            if bounds[i] <= LEAST or (len(held) == most and bounds[i] < held[0][0] - 1e-8):
                break
            score = 0.0
            for text, rest, bound in sorted(parts, key=lambda p: -p[2][i]):
                if bound[i] <= score:
                    break
                self.measured += 1
                score = max(score, rest[i] + BLOCKS * max(self.own.ratio(text, i), ANCESTORS * self.around.ratio(text, i)))
            score = round(score, 9)
            if score > LEAST:
                (heapq.heappushpop if len(held) == most else heapq.heappush)(held, (score, -i))
        return [(score, -i) for score, i in sorted(held, reverse=True)]
