"""Toxicity by non-negative positive-unlabelled learning.

A numpy logistic classifier is trained from confirmed toxic texts (positives) and unlabelled texts. With the class
prior p (the toxic share of the labelled training rows) its risk is p E+[loss(1)] + max(0, Eu[loss(0)] - p E+[loss(0)]):
unlabelled texts stand for negatives after the positives among them are taken out, and the part in max() never
counts below zero; while it would, steps go against it.

Features are words, and one, two or three different words that begin with the same 4, 5 or 6 bytes. All of them are
taken that LEAST_COUNT positives have and that unlabelled texts have less often than chance explains; how rare or how
impure a feature is does not matter, the risk and its ridge penalty weigh it. Training reads at most about POSITIVES
and UNLABELLED texts, chosen by a hash of their id; where there are fewer, all. That bounds the features too. Every text
is scored whole.

A null or wordless text gets the score of no feature present. Rows without an id are scored, not learned from. A
document with several labels counts as toxic if one says so; null labels are none. With no positive or no unlabelled
text every score is the prior, or 0 without labels. Other columns, of any name, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordframe.llm.common import mapped, text_column, written
from fjordframe.llm.textbytes import cut, mixed, pieces

POSITIVES, UNLABELLED = 10_000, 20_000
BEGINNINGS, MOST_WORDS = (4, 5, 6), 3
STEPS, RATE, RIDGE = 400, 0.1, 1e-4
#: Features that training holds as columns of a dense matrix, at most.
MOST_DENSE = 1500
#: Positives that have a feature, at least; and the distance of the unlabelled texts that have it from what chance
#: would give, in deviations.
LEAST_COUNT, LEAST_DEVIATION = 4, 6.0

_LETTERS = np.zeros(256, bool)
_LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True


def _once(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows of parallel columns, in order."""
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return tuple(c[new] for c in columns)


def features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, by text; wanted: sorted features to keep, then given by their place there.

    The lowest two bits of a feature are 0 for a word, else how many different words at least share a beginning.
    """
    words = cut(texts, _LETTERS)
    rows, whole = words.rows(), words.hashes()
    sizes, ends = words.ends - words.starts, words.ends
    roots = maybe = None
    if wanted is not None:
        roots = np.unique(wanted >> np.uint64(2))
        maybe = np.zeros(1 << 20, bool)
        maybe[(roots >> np.uint64(42)).astype(np.int64)] = True
    found = []
    for k in (0, *BEGINNINGS):
        if k:
            long = np.flatnonzero(sizes >= k)
            words.ends = np.minimum(ends, words.starts + k)
            key = mixed(words.hashes()[long] + np.uint64(k))
        else:
            long, key = slice(None), whole
        row, word, root = rows[long], whole[long], key >> np.uint64(2)
        if wanted is not None:
            near = np.flatnonzero(maybe[(root >> np.uint64(42)).astype(np.int64)])
            near = near[np.isin(root[near], roots)]
            row, word, root = row[near], word[near], root[near]
        row, root, word = _once(row, root, word)
        if not k:
            found.append((row, root << np.uint64(2)))
            continue
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (root[1:] != root[:-1])
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(row)))
        for least in range(1, MOST_WORDS + 1):
            enough = head[count >= least]
            found.append((row[enough], root[enough] << np.uint64(2) | np.uint64(least)))
    words.ends = ends
    rows, keys = map(np.concatenate, zip(*found, strict=True))
    if wanted is not None:
        at = np.minimum(np.searchsorted(wanted, keys), max(0, len(wanted) - 1))
        here = wanted[at] == keys if len(wanted) else np.zeros(len(keys), bool)
        rows, keys = rows[here], at[here]
    order = np.argsort(rows, kind="stable")
    return rows[order], keys[order]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def risk_slope(z: np.ndarray, plus: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The step's gradient by text scores z; plus and u are the texts' shares in p E+ and in Eu.

    While the negative risk is below zero the step goes against it, and against nothing else.
    """
    as_negative = np.logaddexp(0, z)
    against = (u - plus) * _sigmoid(z)
    return against - plus * _sigmoid(-z) if u @ as_negative >= plus @ as_negative else -against


def fit(rows: np.ndarray, columns: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, n_features: int, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative positive-unlabelled logistic risk, by Adam over all texts."""
    n = len(positive)
    w = np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    plus, u = prior * positive / max(1, positive.sum()), unlabelled / max(1, unlabelled.sum())
    # Features of many texts go through a dense matrix, which is faster; their number is bounded, and so are the texts.
    counts = np.bincount(columns, minlength=n_features)
    common = np.argsort(-counts, kind="stable")[:MOST_DENSE]
    common = common[counts[common] * 25 >= max(1, n)]
    place = np.full(n_features, -1)
    place[common] = np.arange(len(common))
    often = place[columns] >= 0
    dense = np.zeros((n, len(common)), np.float32)
    dense[rows[often], place[columns[often]]] = 1
    rows, columns = rows[~often], columns[~often]
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[columns], n) + dense @ w[common].astype(np.float32) + w[-1]
        slope = risk_slope(z, plus, u)
        by_feature = np.bincount(columns, slope[rows], n_features).astype(float)
        by_feature[common] = slope.astype(np.float32) @ dense
        g = np.append(by_feature, slope.sum()) + RIDGE * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, positives, unlabelled): how many of a task's texts of each kind have it."""
    for whole in batches:
        for b in pieces(whole, "text"):
            rows, keys = features(b["text"])
            kinds = [b[c].to_numpy(zero_copy_only=False)[rows].astype(np.int64) for c in ("positive", "unlabelled")]
            distinct, at = np.unique(keys, return_inverse=True)
            sums = [np.bincount(at, k, len(distinct)).astype(np.int64) for k in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), *map(pa.array, sums)], names=["feature", "positives", "unlabelled"])


def _chosen(wanted: np.ndarray):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text"):
                rows, columns = features(b["text"], wanted)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(b.num_rows + 1)), pa.int32()), pa.array(columns, pa.int32()))
                yield pa.RecordBatch.from_arrays([b["positive"], b["unlabelled"], lists], names=["positive", "unlabelled", "columns"])

    return emit


class Model:
    """Sorted features with their weights, and the score of a text with none of them."""

    def __init__(self, wanted: np.ndarray, weights: np.ndarray, bias: float):
        self.wanted, self.weights, self.bias = wanted, weights, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        rows, columns = features(texts, self.wanted)
        return _sigmoid(np.bincount(rows, self.weights[columns], len(texts)) + self.bias)


def trained(docs: DataFrame, labels: DataFrame, training: Column) -> Model:
    """The model of the texts and labels in the training fold (a column over doc_id)."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(training).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n_known, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0))).first()
    if not n_known or not n_toxic:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -700.0)
    prior = min(n_toxic / n_known, 0.99)
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    toxic = written(known.where("toxic = 1").where(lot < POSITIVES / n_toxic).select("doc_id"), "positives")
    texts = docs.where(training).where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    n_texts = texts.count()
    # The positives' ids number about POSITIVES at most.
    drawn = texts.join(F.broadcast(toxic.withColumn("positive", F.lit(True))), "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    drawn = drawn.withColumn("unlabelled", lot < (UNLABELLED / n_texts if n_texts else 1.0)).where("positive OR unlabelled").select("positive", "unlabelled", "text")
    drawn = written(drawn, "drawn")
    n_positive, n_unlabelled = drawn.agg(F.count_if("positive"), F.count_if("unlabelled")).first()
    if not n_positive or not n_unlabelled:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    tally = drawn.transform(mapped, _tally, "feature long, positives long, unlabelled long").groupBy("feature").agg(F.sum("positives").alias("p"), F.sum("unlabelled").alias("u"))
    neutral = F.col("p") * n_unlabelled / n_positive  # unlabelled texts that would have a feature unrelated to toxicity
    telling = (F.col("p") >= LEAST_COUNT) & (neutral - F.col("u") >= LEAST_DEVIATION * F.sqrt(neutral))
    wanted = np.sort(tally.where(telling).select("feature").toArrow()["feature"].to_numpy().view(np.uint64))
    table = drawn.transform(mapped, _chosen(wanted), "positive boolean, unlabelled boolean, columns array<int>").toArrow()
    columns = table["columns"].combine_chunks()
    rows = np.repeat(np.arange(len(columns)), np.diff(columns.offsets.to_numpy()))
    kinds = [table[c].to_numpy().astype(float) for c in ("positive", "unlabelled")]
    return Model(wanted, *fit(rows, columns.flatten().to_numpy(), *kinds, prior, len(wanted)))


def toxicity_scores(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a score added under a name that docs does not have; docs must have a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(arrays: Iterator[tuple[pa.Array]]) -> Iterator[pa.Array]:
        for (text,) in arrays:
            parts = [shared.value.scores(b["text"]) for b in pieces(pa.RecordBatch.from_arrays([text], names=["text"]), "text")]
            yield pa.array(np.concatenate([np.zeros(0), *parts]))

    return docs.withColumn(column, text_column(docs.sparkSession, judge, "double", "text"))
