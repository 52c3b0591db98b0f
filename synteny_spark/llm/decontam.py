"""Benchmark decontamination: rare n-gram seeds (word pairs), then Smith-Waterman alignment.

Word pairs of the benchmark are counted over all documents, and those of an item in the fewest documents are its seeds, as many
as leave no alignment at the threshold without one: of matches m and errors e, in at most e + 1 runs, at least m - e - 1 pairs are
whole, and m - e is the score, so an item of n words keeps ceil(threshold * n) - 1 of its n - 1 pairs and one of any
n - ceil(threshold * n) + 1 is among them. Longer n-grams can't promise that: a word put in after every second one breaks them all
and scores over 0.5. A document meets an item where it has one of its seeds; around the seeds, at the places that they imply, the
item is aligned with the document by local alignment of words (match 1, mismatch and gap -1). Its score over the item's words is
the similarity; 1 is a whole copy, and edited or paraphrased copies score by what is left in order.

Words are lower-cased runs of letters and digits. The benchmark is taken in blocks of at most BLOCK items and BLOCK_CHARS
characters (or one item), each sent to all tasks, so what is sent is bounded. Items of fewer than LEAST_WORDS words can't be told
from chance inside a text: such an item is found in a document that has its words and no others, with score 1. Null texts count as
empty, and an item without words matches nothing; equal items are found each. Of pairs in as few documents those earlier in the
item are seeds. Repeated documents give repeated rows. An empty table on either side gives an empty result; other columns may have
any names.
"""

from __future__ import annotations

import re
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synteny_spark.llm.common import per_text, texts

N_GRAM, LEAST_WORDS, THRESHOLD, BLOCK, BLOCK_CHARS = 2, 3, 0.5, 20_000, 8 << 20
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Items:
    """Items as numbers of their words, and their n-grams as single numbers."""

    def __init__(self, rows: list[tuple[int, str]], n: int = N_GRAM):
        self.n, self.vocabulary = n, {}
        self.ids = [r[0] for r in rows]
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(t or "")], np.int64) for _, t in rows]
        self.short: dict[tuple[int, ...], list[int]] = {}
        for k, w in enumerate(self.words):
            if 0 < len(w) < LEAST_WORDS:
                self.short.setdefault(tuple(w.tolist()), []).append(k)
        self.grams = np.unique(np.concatenate([np.empty(0, np.int64), *map(self.grams_of, self.words)]))
        self.seeds: dict[int, list[tuple[int, int]]] = {}
        self.seed_grams = np.empty(0, np.int64)

    def grams_of(self, numbers: np.ndarray) -> np.ndarray:
        """The n-gram at each position, -1 if it has a word that no item has."""
        m = len(numbers) - self.n + 1
        if m < 1:
            return np.empty(0, np.int64)
        out, known = np.zeros(m, np.int64), np.ones(m, bool)
        for k in range(self.n):
            out = out * len(self.vocabulary) + numbers[k : k + m]
            known &= numbers[k : k + m] >= 0
        return np.where(known, out, -1)

    def numbers(self, text: str) -> np.ndarray:
        known = self.vocabulary.get
        return np.array([known(w, -1) for w in words_of(text)], np.int64)

    def choose(self, documents: dict[int, int], threshold: float = THRESHOLD) -> "Items":
        """Takes an item's rarest pairs as seeds, all but as many as any alignment at the threshold keeps less one; documents: how many
        have a pair."""
        for k, words in enumerate(self.words):
            if len(words) < LEAST_WORDS:
                continue
            grams = self.grams_of(words).tolist()
            rarest = sorted(range(len(grams)), key=lambda i: (documents.get(grams[i], 0), i))
            for i in sorted(rarest[: len(words) - ceil(threshold * len(words)) + 1]):
                self.seeds.setdefault(grams[i], []).append((k, i))
        self.seed_grams = np.array(sorted(self.seeds), np.int64)
        return self

    def present(self, text: str, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        numbers = self.numbers(text)
        grams = self.grams_of(numbers)
        if not len(grams) or not len(wanted):
            return numbers, np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.searchsorted(wanted, grams).clip(max=len(wanted) - 1)
        hits = np.flatnonzero((grams >= 0) & (wanted[at] == grams))
        return numbers, hits, grams[hits]

    def leaks(self, text: str, threshold: float = THRESHOLD) -> list[tuple[int, float, int, int, int]]:
        """item id, score, seeds in the aligned window, first word and end of the best alignment, for each item that leaks."""
        numbers, hits, grams = self.present(text, self.seed_grams)
        whole = self.short.get(tuple(numbers.tolist()), ()) if len(numbers) < LEAST_WORDS else ()
        starts: dict[int, list[int]] = {}
        for p, g in zip(hits.tolist(), grams.tolist()):
            for item, q in self.seeds[g]:
                starts.setdefault(item, []).append(p - q)
        out = [(self.ids[k], 1.0, 0, 0, len(numbers)) for k in whole]
        for item, at in sorted(starts.items()):
            words, best = self.words[item], None
            slack = max(4, len(words) - ceil(threshold * len(words)))  # an alignment at the threshold has no more gaps
            at.sort()
            a = 0
            for b in range(1, len(at) + 1):
                if b < len(at) and at[b] - at[b - 1] <= slack:
                    continue
                lo, hi = max(0, at[a] - slack), min(len(numbers), at[b - 1] + len(words) + slack)
                found = self.align(words, numbers[lo:hi], threshold)
                if found and (best is None or found[0] > best[1]):
                    best = (self.ids[item], found[0], b - a, lo + found[1], lo + found[2])
                a = b
            if best:
                out.append(best)
        return out

    @staticmethod
    def align(item: np.ndarray, window: np.ndarray, threshold: float) -> tuple[float, int, int] | None:
        """Score and place of the best local alignment, if the score reaches the threshold."""
        if np.isin(item, window).sum() < threshold * len(item):
            return None  # no alignment can match more words than these
        steps = np.arange(len(window) + 1)
        row, begin = np.zeros(len(window) + 1, np.int64), steps.copy()
        best = (0, 0, 0)
        for w in item.tolist():
            diagonal, up = row[:-1] + np.where(window == w, 1, -1), row[1:] - 1
            now, start = np.zeros_like(row), steps.copy()
            up_wins = up > diagonal
            now[1:] = np.maximum(np.maximum(diagonal, up), 0)
            start[1:] = np.where(now[1:] == 0, steps[1:], np.where(up_wins, begin[1:], begin[:-1]))
            lifted = now + steps  # gaps along the window: the best earlier cell less its distance
            top = np.maximum.accumulate(lifted)
            origin = np.maximum.accumulate(np.where(lifted == top, steps, 0))
            row, begin = top - steps, start[origin]
            j = int(row.argmax())
            if row[j] > best[0]:
                best = (int(row[j]), int(begin[j]), j)
        return (best[0] / len(item), best[1], best[2]) if best[0] >= threshold * len(item) else None


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK, chars: int = BLOCK_CHARS):
    """Items, at most block and chars at once."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).orderBy("item_id", "text")
    part: list[tuple[int, str]] = []
    size = 0
    for r in rows.toLocalIterator():
        if part and (len(part) == block or size + len(r.text) > chars):
            yield Items(part)
            part, size = [], 0
        part.append((r.item_id, r.text))
        size += len(r.text)
    if part:
        yield Items(part)


def seeded(docs: DataFrame, items: Items, threshold: float = THRESHOLD) -> Items:
    """items with seeds by their pairs' document counts over all of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def make():
        items = sent.value
        return lambda batch: [(np.unique(items.present(t, items.grams)[2]).tolist(),) for t in batch]

    found = per_text(docs, make, "grams array<long>").select(F.explode("grams").alias("gram")).groupBy("gram").count()
    return items.choose({r.gram: r["count"] for r in found.collect()}, threshold)  # at most a row for each pair of the block


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, n_seeds, first_word and end_word of each document and item that it leaks."""
    spark, rows, out = docs.sparkSession, texts(docs, id_col, text_col), None
    for items in blocks(benchmark):
        sent = spark.sparkContext.broadcast(seeded(rows, items, threshold))
        make = lambda sent=sent: lambda batch: [(x,) if (x := sent.value.leaks(t, threshold)) else None for t in batch]
        part = per_text(rows, make, "found array<struct<item_id: long, score: double, n_seeds: long, first_word: long, end_word: long>>").select("doc_id", F.inline("found"))
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, score double, n_seeds long, first_word long, end_word long")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that leak no item, all columns."""
    rows, out = texts(docs.withColumn("doc_id", F.lit(0)), text_col=text_col), docs
    for items in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(seeded(rows, items, threshold))

        @F.arrow_udf("boolean")
        def leaky(text: pa.Array) -> pa.Array:
            return pa.array([bool(sent.value.leaks(t or "", threshold)) for t in text.to_pylist()], pa.bool_())  # noqa: B023

        out = out.where(~leaky(F.col(f"`{text_col}`").cast("string")))
    return out
