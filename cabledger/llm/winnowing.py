"""Winnowed fingerprints of documents, and how alike neighbouring and edited texts are by them.

Hashes of all character k-grams come from running sums of a polynomial; the least hash of every window is
kept, the rightmost of equal ones, together with its position. Two texts that share ``window + gram - 1`` characters in
a row always share a kept hash. Documents are dealt into ranges of their id; each range also gets the first document of the
next one, so every document meets its successor without a global sort in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cabledger.session import materialize

GRAM, WINDOW = 16, 35
#: Odd, so that it can be divided out modulo 2**64 (fixed value).
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
#: Documents per range, about; ranges are cut at sampled ids, at most MAX_RANGES of them.
PER_RANGE, MAX_RANGES = 5_000, 20_000
#: Rows handed on at a time.
ROWS_OUT = 500
#: Texts are hashed in overlapping pieces of this many k-grams, so memory does not follow the text.
PIECE = 1 << 20

_powers = {}


def _power(of: int, count: int) -> np.ndarray:
    """of**0 .. of**(count-1) modulo 2**64, kept and doubled as needed."""
    held = _powers.get(of)
    if held is None or len(held) < count:
        size = max(4096, 1 << (count - 1).bit_length())
        held = np.full(size, of, dtype=np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        _powers[of] = held
    return held[:count]


def _gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """32-bit hash of every k-gram: a slice of the running polynomial sum, shifted back and mixed."""
    total = np.concatenate(([np.uint64(0)], np.cumsum((codes + np.uint64(1)) * _power(BASE, len(codes)), dtype=np.uint64)))
    h = (total[gram:] - total[:-gram]) * _power(UNBASE, len(codes) - gram + 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(32)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) kept, by position. A text shorter than a k-gram is one gram of its own length; one with
    fewer k-grams than a window is one window; an empty text keeps nothing."""
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    gram = min(gram, len(codes))
    grams = len(codes) - gram + 1
    window = min(window, grams)
    low, kept = np.uint64(0xFFFFFFFF), []
    for at in range(0, grams - window + 1, PIECE):
        end = min(grams, at + PIECE + window - 1)
        keys = (_gram_hashes(codes[at:end + gram - 1], gram) << np.uint64(32)) | (low - np.arange(at, end, dtype=np.uint64))
        width = 1
        while width < window:  # least of 1, 2, 4, ... neighbours, then of the window
            step = min(width, window - width)
            keys = np.minimum(keys[:-step], keys[step:])
            width += step
        kept.append(keys[np.concatenate(([True], keys[1:] != keys[:-1]))])
    keys = np.concatenate(kept)
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    return keys >> np.uint64(32), low - (keys & low)


def fingerprint_text(kept: tuple[np.ndarray, np.ndarray]) -> str:
    """hash@position of every kept gram in hexadecimal, comma-joined."""
    return ",".join([f"{h:08x}@{p:x}" for h, p in zip(kept[0].tolist(), kept[1].tolist())])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted sets of hashes; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM,
                 window: int = WINDOW) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of ``docs``.

    The next document is the following row by ascending id, after the last the first; a null id comes first, rows of
    one id follow each other by text, so equal rows give equal results up to which of them is followed by a different
    one. The edited text has the last half of the characters replaced by the first as many of the next. Null counts
    as empty; an empty text has an empty fingerprint. A single row is its own next. An empty table gives no rows;
    other columns are not read. Ids are integers.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select(F.coalesce("id", F.lit(-(1 << 63))).alias("rank"))
    total = ids.count()
    wanted = min(MAX_RANGES, max(12, total // PER_RANGE))
    # At most MAX_RANGES sampled ids reach the driver, whatever the size of the table.
    cuts = sorted(set(ids.agg(F.percentile_approx("rank", [i / wanted for i in range(1, wanted)], 20 * wanted)).first()[0] or []))
    bounds = rows.sparkSession.sparkContext.broadcast(np.array(cuts, dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(rank: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, rank.to_numpy(), side="left").astype(np.int32))

    rank = F.coalesce("id", F.lit(-(1 << 63)))
    firsts = rows.select(range_of(rank).alias("range"), F.struct(rank.alias("rank"), "text").alias("row"))
    firsts = materialize(firsts.groupBy("range").agg(F.min("row").alias("first")))
    order = [r["range"] for r in firsts.select("range").orderBy("range").collect()]  # at most MAX_RANGES numbers
    before = rows.sparkSession.createDataFrame([(r, order[i - 1]) for i, r in enumerate(order)], "range int, back int")
    ends = firsts.join(before, "range").select(F.col("back").alias("range"), F.lit(True).alias("end"), F.col("first.rank").alias("rank"),
                                               F.lit(None).cast("bigint").alias("id"), F.col("first.text").alias("text"))
    both = rows.select(range_of(rank).alias("range"), F.lit(False).alias("end"), rank.alias("rank"), "id", "text").unionByName(ends)
    dealt = (both.repartitionById(max(order, default=0) + 1, F.col("range")).sortWithinPartitions("range", "end", "rank", "text")
             .select("id", "text", "end"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (id, text, kept, set of hashes) of the row before
        for batch in batches:
            out = []
            for one, cell, end in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = cell.as_py()
                kept = winnow(text, gram, window)
                now = (one, text, kept, np.unique(kept[0]))
                if held is not None:
                    changed = _edited(held[1], text)
                    other = winnow(changed, gram, window)
                    out.append((held[0], len(held[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                                fingerprint_text(held[2]), fingerprint_text(other), likeness(held[3], np.unique(other[0])),
                                likeness(held[3], now[3])))
                held = None if end else now
                if len(out) == ROWS_OUT:
                    yield pack(out)
                    out = []
            if out:
                yield pack(out)

    def pack(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
            pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
    return dealt.mapInArrow(compare, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                                     "edited_fingerprint string, near_edited double, near_next double")
