"""Candidate places of many patterns in one pass: an automaton over the words that their
matches begin at finds where each pattern has to be tried, and it is tried nowhere else."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import ahocorasick

from chartweave.functions.personal_data import Lead


def lower(text: str) -> str:
    """``text`` in lower case, place by place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Places:
    """For each pattern its anchors: leads of digits, or words and how many characters before
    one, blanks apart, a match can begin (null: anywhere in the text)."""

    def __init__(self, patterns: list[re.Pattern], anchors: list[list[Lead] | tuple[tuple[str, ...], int | None]], boundary: str = "ascii"):
        self.patterns, self.anchors = patterns, anchors
        self.digits = re.compile("[0-9]+" if boundary == "ascii" else r"\d+")
        words: dict[str, list[int]] = {}
        self.leads: list[tuple[int, Lead]] = []
        for k, own in enumerate(anchors):
            if isinstance(own, list):
                self.leads += [(k, lead) for lead in own]
            else:
                for word in own[0]:
                    words.setdefault(word, []).append(k)
        self.firsts = {d for _, lead in self.leads for d in lead.first or ""}
        self.longest = 1 + max((n for _, lead in self.leads for n in (lead.least, lead.most or 0)), default=0)
        self.led = functools.lru_cache(4096)(self._led)
        self.automaton = ahocorasick.Automaton()
        for word, users in words.items():
            self.automaton.add_word(word, (len(word), users))
        if words:
            self.automaton.make_automaton()
        self.any_word = bool(words)

    def _led(self, size: int, first: str | None, after: str) -> list[tuple[int, int]]:
        """The patterns that can begin at a run of digits, with how far before it; sizes of
        ``longest`` and more are one, as are digits that no lead asks for."""

        def fits(lead: Lead) -> bool:
            behind = lead.after is None or (after != "" and (" " if after.isspace() else after) in lead.after)
            return behind and lead.least <= size <= (lead.most or size) and (lead.first is None or first is not None and first in lead.first)

        return [(k, lead.back) for k, lead in self.leads if fits(lead)]

    def _tried(self, text: str, found: list[int], reach: int) -> Iterable[int]:
        if not reach:
            return found
        places: list[int] = []
        for at in found:
            left, k, own = reach, at, [at]
            while k and left:
                k -= 1
                own.append(k)
                left -= not text[k].isspace()
            places += [k for k in reversed(own) if not places or k > places[-1]]
        return places

    def matches(self, text: str, low: str | None = None) -> Iterator[tuple[int, re.Match]]:
        """(pattern, match) of every pattern, as ``finditer`` finds them, pattern by pattern;
        ``low`` is the text in lower case, if it is there already."""
        hits: dict[int, list[int]] = {}
        if self.any_word:
            for end, (size, users) in self.automaton.iter(lower(text) if low is None else low):
                for k in users:
                    hits.setdefault(k, []).append(end + 1 - size)
        for m in self.digits.finditer(text) if self.leads else ():
            at, end = m.span()
            first = text[at]
            for k, back in self.led(min(end - at, self.longest), first if first in self.firsts else None, text[end : end + 1]):
                if at >= back:
                    hits.setdefault(k, []).append(at - back)
        for k in sorted(hits):
            pattern, own = self.patterns[k], self.anchors[k]
            if isinstance(own, list):
                places = hits[k]
            elif own[1] is None:
                yield from ((k, m) for m in pattern.finditer(text))
                continue
            else:
                places = self._tried(text, sorted(hits[k]), own[1])
            end = 0
            for at in places:
                if at >= end and (m := pattern.match(text, at)):
                    yield k, m
                    end = m.end()


class Markers:
    """Marker words with no letter or digit next to them, the longest at each place, each with
    what ``tail`` finds behind it. Any number of markers costs one pass."""

    def __init__(self, words: Iterable[str], tail: re.Pattern, any_case: bool):
        self.tail, self.any_case, self.automaton = tail, any_case, ahocorasick.Automaton()
        for word in words:
            word = lower(word) if any_case else word
            self.automaton.add_word(word, len(word))
        self.filled = len(self.automaton) > 0
        if self.filled:
            self.automaton.make_automaton()

    def spans(self, text: str, low: str) -> Iterator[tuple[int, int]]:
        if not self.filled:
            return
        longest: dict[int, int] = {}
        for last, size in self.automaton.iter(low if self.any_case else text):
            start, end = last + 1 - size, last + 1
            if not (text[start - 1 : start].isalnum() or text[end : end + 1].isalnum()):
                longest[start] = max(longest.get(start, 0), end)
        done = 0
        for start in sorted(longest):
            if start >= done:
                m = self.tail.match(text, longest[start])
                done = m.end() if m else longest[start]
                yield start, done
