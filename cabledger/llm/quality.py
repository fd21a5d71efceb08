"""Quality classifier: a factorisation machine over hashed words, structure statistics and the length.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2]), the sum of squares taking the place of all
pairs, so a text costs time linear in its features. Fitted on a bounded draw of labelled documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cabledger.llm.labelled import draw, held_out, labelled_ids, texts_of

BUCKETS, RANK = 4096, 8
#: Labelled documents fitted on, at most, in the shares in which the labels stand.
FIT_DOCS = 8_000
EPOCHS, BATCH, RATE, RIDGE = 12, 128, 0.02, 1e-4
STEPS = 8
HELD = 300_000
_WORD = re.compile(r"\S+")
_LETTERS = re.compile(r"[^\W\d_]+")


def structure(text: str, words: list[str], counts: Counter) -> list[float]:
    """Shares between 0 and 1 that tell prose from lists, shouting, repetition and noise, and the length."""
    n, size = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, _LETTERS.findall(text)))
    digits = sum(map(text.count, "0123456789"))
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    odd = sum(map(text.count, "#$%&*|!@~^<>{}[]=+\\\\/_"))
    stops = sum(map(text.count, ".!?"))
    repeats = sum(1 for a, b in zip(words, words[1:]) if a == b)
    pairs = len(set(zip(words, words[1:])))
    return [len(counts) / n, counts.most_common(1)[0][1] / n if counts else 1.0, repeats / n, pairs / n, letters / size,
            digits / size, upper / n, min(1.0, 20 * odd / size), min(1.0, 10 * stops / n), len(set(lines)) / max(1, len(lines)),
            min(1.0, sum(map(len, words)) / n / 20), min(1.0, max(map(len, words), default=0) / 40),
            min(1.0, len(lines) / n * 5), min(1.0, math.log1p(len(words)) / 10), min(1.0, math.log1p(size) / 12),
            float(not text.strip())]


STATS = 16
FEATURES = BUCKETS + STATS * (STEPS + 2)


def features(text: str | None, hashes: dict[str, int]) -> tuple[list[int], list[float]]:
    """Indices and values: words by bucket, scaled to length 1; each statistic as a value and as one of its steps."""
    text = text or ""
    words = _WORD.findall(text)
    counts = Counter(w.lower() for w in words)
    sums: dict[int, float] = {}
    if len(hashes) > HELD:
        hashes.clear()
    for word, k in counts.items():
        at = hashes.get(word)
        if at is None:
            at = hashes[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        sums[at] = sums.get(at, 0.0) + 1.0 + math.log(k)
    norm = math.sqrt(sum(v * v for v in sums.values())) or 1.0
    index, value = list(sums), [v / norm for v in sums.values()]
    for i, x in enumerate(structure(text, words, counts)):
        base = BUCKETS + i * (STEPS + 2)
        index += [base, base + 1 + min(STEPS, int(x * STEPS))]
        value += [x, 0.5]
    return index, value


class FactorisationMachine:
    def __init__(self, size: int = FEATURES, rank: int = RANK, seed: int = 11):
        self.w0, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, rank))

    def margins(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margin and factor sums per row of a CSR block; every row has a feature."""
        each = self.v[index] * value[:, None]
        sums = np.add.reduceat(each, starts)
        pairs = 0.5 * (sums ** 2 - np.add.reduceat(each ** 2, starts)).sum(axis=1)
        return self.w0 + np.add.reduceat(self.w[index] * value, starts) + pairs, sums

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        """Adam on the logistic loss, in an order fixed by a seed."""
        rng, params = np.random.default_rng(5), [self.w, self.v]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
        bias, step = [0.0, 0.0], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                part = order[at:at + BATCH]
                sizes = np.array([len(rows[i][0]) for i in part])
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                index, value = (np.concatenate([rows[i][k] for i in part]) for k in (0, 1))
                margin, sums = self.margins(index, value, starts)
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]) / len(part)
                pull = np.repeat(error, sizes) * value
                own = pull[:, None] * (np.repeat(sums, sizes, axis=0) - self.v[index] * value[:, None])
                slopes = [np.bincount(index, pull, len(self.w)) + RIDGE * self.w,
                          np.column_stack([np.bincount(index, own[:, f], len(self.w)) for f in range(own.shape[1])]) + RIDGE * self.v]
                step += 1
                for p, (m, s), g in zip(params, moments, slopes):
                    m *= 0.9
                    m += 0.1 * g
                    s *= 0.999
                    s += 0.001 * g * g
                    p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
                bias[0] = 0.9 * bias[0] + 0.1 * error.sum()
                bias[1] = 0.999 * bias[1] + 0.001 * error.sum() ** 2
                self.w0 -= RATE * (bias[0] / (1 - 0.9 ** step)) / (math.sqrt(bias[1] / (1 - 0.999 ** step)) + 1e-8)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes: dict[str, int] = {}
    for batch in batches:
        found = [features(t.as_py(), hashes) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([i for i, _ in found], pa.list_(pa.int32())),
                                          pa.array([v for _, v in found], pa.list_(pa.float64()))], ["label", "index", "value"])


def _pieces(column: pa.ChunkedArray) -> list[np.ndarray]:
    """One array per row of a list column."""
    out = []
    for chunk in column.chunks:
        flat, ends = chunk.flatten().to_numpy(), np.cumsum(chunk.value_lengths().to_numpy())
        out += np.split(flat, ends[:-1]) if len(ends) else []
    return out


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality", fit_docs: int = FIT_DOCS) -> DataFrame:
    """``docs`` with all its rows and columns, plus ``held_out`` and ``score``, the probability of label 1.

    Only labels of ids whose crc32 as text is not divisible by 5 are used; the others are held out. Texts alone are scored;
    null counts as empty, and an empty text has its structure features only. Repeated rows are scored alike. A null
    id is not held out and has no label. If one class has no labelled document, all scores are 1 (no label 0) or 0.
    An empty table gives no rows. Columns of ``docs`` named ``held_out`` or ``score`` are replaced.
    """
    fit = texts_of(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
                   draw(labelled_ids(labels, id_col, label_col), fit_docs))
    drawn = fit.mapInArrow(_sparse, "label int, index array<int>, value array<double>").toArrow().combine_chunks()
    y = drawn.column("label").to_numpy().astype(float)
    have = [(y == c).any() for c in (0, 1)]
    if not all(have):
        return docs.withColumn("held_out", held_out(F.col(id_col))).withColumn("score", F.lit(0.0 if have[0] else 1.0))
    rows = list(zip(_pieces(drawn.column("index")), _pieces(drawn.column("value"))))
    machine = FactorisationMachine()
    machine.fit(rows, y)
    held = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes: dict[str, int] = {}
        for part in texts:
            found = []
            for at in range(0, len(part), 256):
                each = [features(t, hashes) for t in part.iloc[at:at + 256]]
                starts = np.concatenate(([0], np.cumsum([len(i) for i, _ in each])[:-1]))
                margin, _ = held.value.margins(np.concatenate([i for i, _ in each]), np.concatenate([v for _, v in each]), starts)
                found.append(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
            yield pd.Series(np.concatenate(found) if found else np.empty(0))
    return docs.withColumn("held_out", held_out(F.col(id_col))).withColumn("score", score(F.col(text_col)))
