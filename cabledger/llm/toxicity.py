"""Toxicity by class-conditional Kneser-Ney models.

A class counts each word by the number of different words before it, the continuation count, so a passage that is
copied a thousand times counts once. Words are spelt as characters between a start and an end mark, and each class
has its own counts of characters after contexts of up to ``ORDER - 1`` characters. From ``SHARED`` characters of context
downwards both classes back off to the same counts, gathered from the distinct words of all texts, so a rare spelling is
judged by the longest part that has been seen and pulls to neither side where nothing is known. A word's evidence is
the difference of its two log-likelihoods; a text's is the length-normalised difference of its strongest window of
each length in ``WINDOWS`` and of the whole, calibrated together to a probability on labelled documents the models
have not seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cabledger.llm.labelled import draw, held_out, labelled_ids, texts_of

ORDER, SHARED = 5, 1
#: Windows, in words, whose strongest one is evidence, besides the mean of the whole text.
WINDOWS = (2, 8, 32, 128)
#: Labelled documents the models are fitted on, at most, per class; and as many for the calibration, of both classes.
#: They are drawn by a hash of their id, and the two draws share no document.
FIT_DOCS = 2_000
#: Distinct words a task holds before it hands them on or forgets their scores.
HELD = 400_000
WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def spelt(word: str) -> str:
    return "\x02" + word + "\x03"


def _seen(words: dict[str, int], lengths: range, longest: int) -> dict[str, Counter]:
    """Context -> following characters. The longest contexts, and those that reach the start of the word, add the words'
    counts; shorter ones count distinct words, as lower orders do."""
    seen: dict[str, Counter] = {}
    for word, n in words.items():
        text = spelt(word)
        for i in range(1, len(text)):
            for k in lengths:
                if k > i:
                    break
                seen.setdefault(text[i - k:i], Counter())[text[i]] += n if k == longest or k == i else 1
    return seen


class KneserNey:
    """Interpolated Kneser-Ney over characters; orders above ``shared`` counted per class, the rest together."""

    def __init__(self, counts: list[dict[str, int]], common: dict[str, int], order: int = ORDER, shared: int = SHARED):
        """counts: per class, continuation counts of words; common: distinct words of the corpus per ``gram``."""
        self.order, self.shared = order, shared
        self.high = [self._table(_seen(c, range(shared + 1, order), order - 1)) for c in counts]
        low: dict[str, Counter] = {}
        for gram, n in common.items():
            low.setdefault(gram[:-1], Counter())[gram[-1]] += n
        self.low = self._table(low)

    @staticmethod
    def _table(seen: dict[str, Counter]) -> dict[str, tuple[dict, float, float]]:
        """Context -> (following characters, total, discount)."""
        table = {}
        for context, following in seen.items():
            ones = sum(1 for v in following.values() if v == 1)
            twos = sum(1 for v in following.values() if v == 2)
            discount = min(0.95, max(0.5, ones / (ones + 2 * twos))) if ones + twos else 0.75
            total = float(sum(following.values()))
            table[context] = (dict(following), total, discount)
        return table

    def _at(self, table: dict, context: str, char: str, below: float) -> float:
        entry = table.get(context)
        if entry is None:
            return below
        following, total, discount = entry
        return (max(following.get(char, 0) - discount, 0.0) + discount * len(following) * below) / total

    def gram_ratio(self, gram: str) -> float:
        """log P(last character | those before it), class 1 less class 0; a gram holds all context that is used."""
        char, context = gram[-1], gram[:-1]
        size, base = len(context), 1e-4
        for k in range(0, min(size, self.shared) + 1):
            base = self._at(self.low, context[size - k:], char, base)
        each = [base, base]
        for c in (0, 1):
            for k in range(self.shared + 1, size + 1):
                each[c] = self._at(self.high[c], context[size - k:], char, each[c])
        return math.log(each[1] / each[0])

    def log_ratio(self, word: str, grams: dict[str, float] | None = None) -> float:
        """log P(word | class 1) - log P(word | class 0). ``grams`` keeps what single grams gave."""
        grams, span = {} if grams is None else grams, self.order - 1
        text, ratio = spelt(word), 0.0
        for i in range(1, len(text)):
            gram = text[max(0, i - span):i + 1]
            found = grams.get(gram)
            if found is None:
                found = grams[gram] = self.gram_ratio(gram)
            ratio += found
        return ratio

    def evidence(self, words: list[str], cache: dict[str, float], grams: dict[str, float]) -> list[float]:
        """The highest mean difference over each length of ``WINDOWS`` words in a row, and the mean; 0 without words.

        A text shorter than a window is divided by its own length, at least 2 words."""
        for held in (cache, grams):
            if len(held) > HELD:
                held.clear()
        found = [cache.get(word) for word in words]
        if None in found:
            for i, word in enumerate(words):
                if found[i] is None:
                    found[i] = cache[word] = self.log_ratio(word, grams)
        each = np.array(found or [0.0])
        sums, out = np.concatenate(([0.0], np.cumsum(each))), []
        for window in WINDOWS:
            width = min(window, len(each))
            out.append(float((sums[width:] - sums[:-width]).max() / max(width, WINDOWS[0])))
        return [*out, float(sums[-1] / len(each))]


def common_grams(texts: DataFrame, shared: int = SHARED) -> dict[str, int]:
    """Character grams of up to ``shared`` characters of context -> distinct words of all texts with them.

    The distinct words are found by a shuffle; what reaches the driver are counts per pair of characters.
    """
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[str] = set()
        for batch in batches:
            for cell in batch.column(0):
                held.update(words_in(cell.as_py()))
            if len(held) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string())], ["word"])
                held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string())], ["word"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                text = spelt(word)
                counts.update(text[i - k:i + 1] for i in range(1, len(text)) for k in range(min(i, shared) + 1))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])

    found = (texts.mapInArrow(gather, "word string").distinct().mapInArrow(spell, "gram string, n bigint")
             .groupBy("gram").agg(F.sum("n").alias("n")).toArrow())
    return dict(zip(found.column("gram").to_pylist(), found.column("n").to_pylist()))


def class_counts(texts: DataFrame) -> list[dict[str, int]]:
    """Per class, word -> number of different words before it, over (text, label) rows."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = set()
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                words = words_in(text.as_py())
                held.update(zip([label] * len(words), [""] + words, words))
            if held:
                columns = [pa.array(c) for c in zip(*held)]
                yield pa.RecordBatch.from_arrays([columns[0].cast(pa.int32()), *columns[1:]], ["label", "before", "word"])
    found = (texts.select("text", "label").mapInArrow(pairs, "label int, before string, word string").distinct()
             .groupBy("label", "word").count().toArrow())
    counts: list[dict[str, int]] = [{}, {}]
    for label, word, n in zip(*(found.column(c).to_pylist() for c in ("label", "word", "count"))):
        counts[label][word] = n
    return counts


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Slopes and offset of a ridge logistic regression, by damped Newton steps on scaled columns."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    design = np.column_stack([x / scale, np.ones(len(x))])
    held, beta = np.array([ridge] * x.shape[1] + [1e-9]), np.zeros(x.shape[1] + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (p - y) / len(x) + held * beta
        bend = (design * (p * (1 - p))[:, None]).T @ design / len(x) + np.diag(held)
        step = np.linalg.solve(bend, slope)
        beta = beta - step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    return beta[:-1] / scale, float(beta[-1])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", fit_docs: int = FIT_DOCS) -> DataFrame:
    """(id, held_out, score) for every row of ``docs``; ``score`` is the probability of label 1.

    Only labels of ids whose crc32 as text is not divisible by 5 are used; the others are held out. Texts alone
    are scored: null and empty ones get the score of no evidence. Repeated rows are scored alike. A null id is not
    held out and has no label. If one class has no labelled document, all scores are 0 (no label 1) or 1. An empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spark = rows.sparkSession
    common = common_grams(rows.select("text"))
    ids = labelled_ids(labels, id_col, label_col)
    for_check = F.pmod("_h", F.lit(4)) == 0
    learnt = [draw(ids.filter(~for_check & (F.col("label") == c)), fit_docs) for c in (0, 1)]
    fit = texts_of(rows, learnt[0].unionByName(learnt[1]))
    check = texts_of(rows, draw(ids.filter(for_check), fit_docs))
    counts = class_counts(fit)
    have = [bool(c) for c in counts]
    if not all(have):
        return rows.select("id", held_out(F.col("id")).alias("held_out"), F.lit(1.0 if have[1] else 0.0).alias("score"))
    model = spark.sparkContext.broadcast(KneserNey(counts, common))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        grams: dict[str, float] = {}
        for batch in batches:
            found = [model.value.evidence(words_in(t.as_py()), cache, grams) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["id", "evidence"])

    seen = check.select("label", "text").mapInArrow(weigh, "id int, evidence array<double>").toArrow()
    y = seen.column("id").to_numpy()
    if len(set(y.tolist())) == 2:
        slopes, offset = logistic(np.array(seen.column("evidence").to_pylist()), y)
    else:  # nothing to calibrate on: one nat a word over a short window counts as even
        slopes, offset = np.array([1.0] + [0.0] * len(WINDOWS)), -2.0
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(weigh, f"id {kind}, evidence array<double>")
    margin = sum((F.get("evidence", F.lit(i)) * float(k) for i, k in enumerate(slopes)), F.lit(offset))
    return scored.select("id", held_out(F.col("id")).alias("held_out"), (1 / (1 + F.exp(-margin))).alias("score"))
