"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct lower-cased words and the first four and five letters of longer ones, hashed to 2^40 buckets. The
model has a weight for each bucket and a vector for each, whose products are the weights of pairs: an insult beside a mention of
a group may so count for more than both alone.

It is fitted on at most PER_LABEL rows of either label, those of the least hashed ids. Equal texts count as one, with the label that
most of them have (of as many: 1). What is counted over them is counted on the executors, and the driver gets at most TERMS
buckets, half by evidence and the rest by rows, and their presence in these rows. Every row of any size is scored, over
its whole text. Without both labels to learn from, each text scores the smoothed share of label 1.

Null texts count as empty and get the score of a text without terms. Of an id with several labels the highest counts. Rows with a
null id are scored, never learned from. Repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synteny_spark.llm.common import per_text, texts
from synteny_spark.operators.spread import checkpointed

#: The fit's bounds: rows of either label, buckets.
PER_LABEL, TERMS = 5000, 4096
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 30, 256, 0.05, 5e-5
THRESHOLD = 0.7
BUCKETS = 1 << 40
EDGES = ".,;:!?\"'()[]{}<>«»¡¿*#$%&|-_"


def word_terms(word: str) -> tuple[int, ...]:
    """The buckets of a lower-cased word."""
    from xxhash import xxh64_intdigest

    w = word.strip(EDGES)
    if not w:
        return ()
    return tuple(xxh64_intdigest(t) % BUCKETS for t in (w, *("^" + w[:n] for n in (4, 5) if len(w) > n)))


class Terms:
    """Distinct buckets of texts; of the wanted ones only, if those are given, as their numbers."""

    LIMIT = 400_000

    def __init__(self, wanted: dict[int, int] | None = None):
        self.wanted, self.known = wanted, {}

    def of(self, text: str) -> list[int]:
        out: set[int] = set()
        known, wanted = self.known, self.wanted
        if len(known) > self.LIMIT:
            known.clear()
        for word in set(text.lower().split()):
            found = known.get(word)
            if found is None:
                found = word_terms(word)
                found = known[word] = found if wanted is None else tuple(wanted[t] for t in found if t in wanted)
            if found:
                out.update(found)
        return sorted(out)


@dataclass
class Machine:
    """bias, and for each bucket a weight and a vector."""

    buckets: dict[int, int] = field(default_factory=dict)
    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))

    def logit(self, terms: list[int]) -> float:
        v = self.vectors[terms]
        return self.bias + self.weights[terms].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())

    def scores(self, batch: list[str], terms: Terms | None = None) -> list[float]:
        terms = terms or Terms(self.buckets)
        return [float(1 / (1 + np.exp(-np.clip(self.logit(terms.of(t)), -40, 40)))) for t in batch]


def summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the stretches of rows of values that begin at first, none of them empty."""
    return np.add.reduceat(values, first) if len(first) else values[:0]


def fit(rows: list, labels: np.ndarray, buckets: dict[int, int], seed: int = 7) -> Machine:
    """Adam on the logistic loss, from small random vectors; rows hold numbers of buckets."""
    rng, n = np.random.default_rng(seed), len(buckets)
    params = [np.array([np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))]), np.zeros(n), rng.normal(0, 0.01, (n, FACTORS))]
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    if not labels.any() or labels.all() or not n:
        return Machine(dict(buckets), float(params[0][0]), params[1], params[2] * 0)
    rows = [np.asarray(r, np.int64) for r in rows]
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(rows)), -(-len(rows) // BATCH)):
            sizes = np.array([len(rows[i]) for i in part])
            of, at = np.repeat(np.arange(len(part)), sizes), np.concatenate([rows[i] for i in part])
            v, sums = params[2][at], np.zeros((len(part), FACTORS))
            sums[sizes > 0] = summed(v, (np.cumsum(sizes) - sizes)[sizes > 0])
            squares = np.bincount(of, (v**2).sum(1), len(part))
            z = params[0][0] + np.bincount(of, params[1][at], len(part)) + 0.5 * ((sums**2).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[part]) / len(part)
            pair = np.zeros_like(params[2])
            order = np.argsort(at, kind="stable")
            here, first = np.unique(at[order], return_index=True)
            pair[here] = summed((g[of, None] * (sums[of] - v))[order], first)
            step += 1
            for k, grad in enumerate((np.array([g.sum()]), np.bincount(at, g[of], n) + DECAY * params[1], pair + DECAY * params[2])):
                m1[k] += 0.1 * (grad - m1[k])
                m2[k] += 0.001 * (grad**2 - m2[k])
                params[k] -= RATE * m1[k] / (1 - 0.9**step) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(dict(buckets), float(params[0][0]), params[1], params[2])


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row is never learned from; false for a null id, which has no label."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, text and y of the rows to learn from; labels has doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    return docs.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")  # at most 2 * per_label small rows


def learned(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL) -> Machine:
    rows = labelled(texts(docs, id_col, text_col), labels, label_col, per_label).groupBy(F.sha2("text", 256).alias("same")).agg((2 * F.sum("y") >= F.count("*")).cast("int").alias("y"), F.max("text").alias("text"))
    rows = checkpointed(per_text(rows, lambda: lambda batch, t=Terms(): [(t.of(x),) for x in batch], "terms array<long>", ("same", "y")))
    n0, n1 = (rows.where(F.col("y") == y).count() for y in (0, 1))
    seen = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    part = lambda x, of, n: F.when(x > 0, x * F.log(x * (n0 + n1) / (of * n))).otherwise(0.0)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    g2 = 2 * (part(a, a + b, max(n1, 1)) + part(b, a + b, max(n0, 1)) + part(n1 - a, n0 + n1 - a - b, max(n1, 1)) + part(n0 - b, n0 + n1 - a - b, max(n0, 1)))
    ranked = checkpointed(seen.select("term", g2.alias("g2"), (a + b).alias("rows")))
    terms = [r.term for r in ranked.orderBy(F.desc("g2"), "term").limit(TERMS // 2).collect()]
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term long"))  # TERMS rows at most
    terms += [r.term for r in ranked.join(known, "term", "left_anti").orderBy(F.desc("rows"), "term").limit(TERMS - len(terms)).collect()]
    buckets = {t: i for i, t in enumerate(terms)}
    if not buckets:
        return fit([], np.array([1.0] * n1 + [0.0] * n0), {})
    sent = spark.sparkContext.broadcast(buckets)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [np.array(sorted(sent.value[t] for t in ts if t in sent.value), np.int32).tobytes() for ts in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.binary())], names=["same", "y", "at"])

    have = rows.select("same", "y", "terms").mapInArrow(numbered, "same string, y int, at binary").orderBy("same").collect()
    return fit([np.frombuffer(r.at, np.int32) for r in have], np.array([r.y for r in have], float), buckets)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = texts(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    scored = per_text(rows, lambda: lambda batch, t=Terms(sent.value.buckets): [(s,) for s in sent.value.scores(batch, t)], "score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    held: dict = {}

    @F.arrow_udf("double")
    def score_of(text: pa.Array) -> pa.Array:
        terms = held.setdefault("terms", Terms(sent.value.buckets))
        return pa.array(sent.value.scores([t or "" for t in text.to_pylist()], terms), pa.float64())

    return docs.where(score_of(F.col(f"`{text_col}`").cast("string")) < threshold)
