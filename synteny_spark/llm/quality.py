"""Quality rules as a short-circuit cascade.

The base counts are part of every row's result, so every text pays for them and the base rule comes first, at no cost of its own.
Each other rule's cost and selectivity are measured, after the base counts, on a sample of the texts that the base rule leaves;
rules then run in the order of rejections per cost, each counted over what the rules before it leave, and a text that one rejects
is not shown to the rest. The order decides what a verdict costs, never the verdict, since a text is kept only if no rule rejects
it.

The sample is drawn from all partitions at random and measured where it lies; the driver gets seconds and verdicts, no texts. Null
and empty texts have no words and fail the base rule. Ties in the order go by the rule's name. Repeated rows give repeated
results; an empty table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synteny_spark.llm.common import per_text, texts

#: Rows by which rules are ordered: about so many, at most four times as many.
SAMPLE = 500
WINDOW = 8
#: Words in a stretch whose distinct words are counted together.
STRETCH = 2000
SYMBOLS = "#*$%&|<>"


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """How many words lie in windows of size words that occur twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    if len(ids) == len(words):
        return 0
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + x[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    groups: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(twice).tolist():  # equal hashes are compared word by word
        groups.setdefault(tuple(words[i : i + size]), []).append(i)
    steps = np.zeros(len(words) + 1, np.int64)
    for at in groups.values():
        if len(at) > 1:
            np.add.at(steps, at, 1)
            np.add.at(steps, np.array(at) + size, -1)
    return int((np.cumsum(steps) > 0).sum())


class Text:
    """A text with what rules need, computed when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # at ASCII white space only, as bytes do

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\v\f\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def variety(self) -> float:
        """Distinct words over words in stretches of one length (the last ends with the text), so that long texts are judged like
        those of one stretch."""
        size = min(self.n_words, STRETCH)
        starts = {*range(0, self.n_words - size + 1, max(size, 1)), self.n_words - size}
        return sum(len(set(self.words[i : i + size])) for i in starts) / max(len(starts) * size, 1)

    @cached_property
    def base(self) -> tuple:
        return self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words, self.base_failed

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


#: name and test; a text is rejected if any test holds.
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "duplicate_lines": lambda t: 2 * t.n_dup_lines > len(t.lines),
    "stutter": lambda t: 3 * sum(a == b for a, b in zip(t.words, t.words[1:])) > t.n_words,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 30 * t.n_words,
    "digits": lambda t: 2 * len(re.findall("[0-9]", t.text)) > len(t.text),
    "few_words": lambda t: 20 * t.variety < 1,
}


def measured(docs: DataFrame, rules: dict[str, Callable[[Text], bool]], sample: int = SAMPLE) -> list[tuple[list[float], list[bool]]]:
    """Seconds and verdict of each rule on each text of the sample that passes the base rule, its base counts being known."""

    def measure(batch: list[str]) -> list[tuple | None]:
        out = []
        for text in batch:
            seconds, rejects = [], []
            for rule in rules.values():
                t = Text(text)
                failed = t.base[-1]  # so that a rule pays only for what the counts leave to do
                began = time.perf_counter()
                rejects.append(bool(rule(t)))
                seconds.append(time.perf_counter() - began)
            out.append(None if not rules or failed else (seconds, rejects))
        return out

    share = sample / max(docs.count(), 1)
    drawn = docs.sample(fraction=min(share, 1.0), seed=9) if share < 1 else docs
    found = per_text(drawn, lambda: measure, "seconds array<double>, rejects array<boolean>").select("seconds", "rejects")
    return [(r.seconds, r.rejects) for r in found.limit(4 * sample).collect()]


def ordered(rules: list[str], rows: list[tuple[list[float], list[bool]]]) -> list[str]:
    """The rules by rejections per second, each over the rows that those before it leave."""
    left, out, todo = list(rows), [], sorted(range(len(rules)), key=lambda k: rules[k])
    while todo:
        gain = lambda k: (sum(r[k] for _, r in left) / (sum(s[k] for s, _ in left) + 1e-9)) if left else 0.0  # noqa: B023, E731
        best = max(todo, key=gain)
        out.append(rules[best])
        todo.remove(best)
        left = [(s, r) for s, r in left if not r[best]]
    return out


def cascade(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] | None = None, sample: int = SAMPLE) -> list[tuple[str, Callable[[Text], bool]]]:
    rules = RULES if rules is None else rules
    return [(k, rules[k]) for k in ordered(list(rules), measured(docs, rules, sample))]


def rejected_by(t: Text, steps: list[tuple[str, Callable[[Text], bool]]]) -> str | None:
    return next((name for name, rule in steps if rule(t)), None)


def judge(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row."""
    rows = texts(docs, id_col, text_col)
    steps = cascade(rows, rules, sample)

    def run(batch: list[str]) -> list[tuple]:
        out = []
        for t in map(Text, batch):
            out.append((*t.base, not t.base[-1] and rejected_by(t, steps) is None))
        return out

    return per_text(rows, lambda: run, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
