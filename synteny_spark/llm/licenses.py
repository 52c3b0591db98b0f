"""License scans by patience alignment.

Words that a stretch of text and a template both have exactly once are anchors; the longest run of anchors in the same order in
both is kept, and the gaps between them are aligned in the same way. A gap without anchors, of any size, is trimmed at both ends
where its words are equal, and what is left is aligned by a longest common subsequence in linear space. The share of the
template's words so aligned is its coverage.

A template of n words can reach the least coverage only with some of any k of its words, k being one more than the share it may
lack; its k longest words point to the places in a text where it is aligned, and texts with none of them are passed over. Places
that differ by at most n words are aligned as one stretch too, so a licence with as many words put in, at one place or several,
is found. Words are lower-cased runs of letters and digits; spans are in code points, the end exclusive.

Null texts count as empty. Of findings of one template that share words, those at one place go before those of joined places, then
the one with the most aligned words counts, then the first. A finding inside a longer one is left out, and so is that of two equal spans with fewer aligned words (of as many: less
coverage, then the later name). Repeated rows give repeated results; an empty table gives an empty result; other columns may have
any names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synteny_spark.llm.common import per_text, texts
from synteny_spark.llm.license_texts import TEMPLATES

COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+")


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by their first, with increasing seconds."""
    ends: list[int] = []
    tails: list[int] = []
    before: list[int] = []
    for i, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        before.append(tails[k - 1] if k else -1)
        ends[k : k + 1] = [j]
        tails[k : k + 1] = [i]
    out, i = [], tails[-1] if tails else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def _lengths(a: list[str], b: list[str]) -> list[int]:
    """The length of a longest common subsequence of a with each beginning of b, by one machine word of bits for many words."""
    where: dict[str, int] = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    free = full  # a bit is clear where the length grows
    for x in a:
        met = free & where.get(x, 0)
        free = ((free + met) | (free - met)) & full
    grown = bin(full & ~free)[2:].zfill(len(b))[::-1]
    return [0, *accumulate(map(int, grown))] if b else [0]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, in space that is linear in both: a is halved, and b where both halves fit best."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.append((a0, b.index(a[a0], b0, b1)))
            continue
        m = (a0 + a1) // 2
        front, back = _lengths(a[a0:m], b[b0:b1]), _lengths(a[m:a1][::-1], b[b0:b1][::-1])
        n = b1 - b0
        k = max(range(n + 1), key=lambda j: front[j] + back[n - j])
        if front[k] + back[n - k]:
            todo += [(a0, m, b0, b0 + k), (m, a1, b0 + k, b1)]
    return sorted(out)


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions of equal words, in order in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[j]: j for j in range(b0, b1)}
        anchors = _increasing([(i, where[a[i]]) for i in range(a0, a1) if na[a[i]] == 1 and nb.get(a[i]) == 1])
        if anchors:
            out += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(edges, edges[1:])]
        else:
            out += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, coverage: float = COVERAGE):
        import ahocorasick

        self.coverage = coverage
        self.templates = {k: WORD.findall(v.lower()) for k, v in sorted((TEMPLATES if templates is None else templates).items())}
        self.templates = {k: v for k, v in self.templates.items() if v}
        self.bags = {k: Counter(v) for k, v in self.templates.items()}
        self.pointers: dict[str, list[tuple[str, int]]] = {}
        self.seen = ahocorasick.Automaton()
        for name, words in self.templates.items():
            chosen: set[str] = set()
            lacking = len(words) - -int(-coverage * len(words) // 1)
            for w in sorted(set(words), key=lambda w: (-len(w), w)):
                if sum(x in chosen for x in words) > lacking:
                    break
                chosen.add(w)
            for q, w in enumerate(words):
                if w in chosen:
                    self.pointers.setdefault(w, []).append((name, q))
                    self.seen.add_word(w, w)
        self.seen.make_automaton()

    def findings(self, text: str) -> list[tuple[str, float, int, int]]:
        """name, coverage, start and end of each place of a template."""
        if next(self.seen.iter(text.lower()), None) is None:
            return []
        at = [(m.start(), m.end()) for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in at]
        starts: dict[str, set[int]] = {}
        for p, w in enumerate(words):
            for name, q in self.pointers.get(w, ()):
                starts.setdefault(name, set()).add(p - q)
        found = []
        for name, places in starts.items():
            template, bag = self.templates[name], self.bags[name]
            n, slack, fits = len(template), len(template) // 4 + 2, set()
            order, last = sorted(places), 0
            windows: dict[tuple[int, int], int] = {}
            for k, s in enumerate(order):
                while last + 1 < len(order) and order[last + 1] <= s + n:
                    last += 1
                for joined, (lo, hi) in enumerate(((s, s + n), (s - slack, s + n + slack), (s - slack, order[last] + n + slack))):
                    windows.setdefault((max(lo, 0), max(hi, 0)), joined // 2)
            for (lo, hi), joined in windows.items():
                part = words[lo:hi]
                if sum((bag & Counter(part)).values()) < self.coverage * n:
                    continue
                pairs = patience(template, part)
                if len(pairs) >= self.coverage * n:
                    fits.add((joined, -len(pairs), lo + pairs[0][1], lo + pairs[-1][1] + 1))
            taken: list[tuple[int, int]] = []
            for _, minus, first, end in sorted(fits):  # the best alignments that share no word
                k = bisect_left(taken, (first, end))
                if (k == 0 or taken[k - 1][1] <= first) and (k == len(taken) or end <= taken[k][0]):
                    taken.insert(k, (first, end))
                    found.append((at[first][0], -at[end - 1][1], minus, minus / n, name))
        out, reach = [], -1
        for start, minus_end, _, minus_share, name in sorted(found):
            if -minus_end > reach:
                reach = -minus_end
                out.append((name, -minus_share, start, reach))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, coverage, span_start and span_end of every finding in every whole text."""

    def make():
        scanner = Scanner(templates, coverage)
        return lambda batch: [(x,) if (x := scanner.findings(t)) else None for t in batch]

    found = per_text(texts(docs, id_col, text_col), make, "found array<struct<license: string, coverage: double, span_start: long, span_end: long>>")
    return found.select("doc_id", F.inline("found"))
