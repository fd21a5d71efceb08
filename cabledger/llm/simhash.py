"""SimHash near-duplicates by a vantage-point tree over the fingerprints.

Fingerprints are partitioned by Hamming distance to vantage points. A point within ``radius`` of a vantage point
goes inside, others go outside, and those outside by no more than the link distance go inside as well, so two
fingerprints that link always meet in a leaf (triangle inequality). The upper tree is fitted on a documented sample
of fingerprints and broadcast; its leaves are the shards of a shuffle, and each shard grows its own lower tree. A
shard hands on a spanning forest of its links, at most one edge per fingerprint in a leaf, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cabledger.llm.components import components
from cabledger.session import materialize

LINK_BITS = 2
SHINGLE = 3
#: Vantage points are fitted on one fingerprint in SAMPLE_STEP, at least MIN_SAMPLE and at most MAX_SAMPLE of them.
SAMPLE_STEP, MIN_SAMPLE, MAX_SAMPLE = 1000, 4096, 1 << 20
#: Sampled fingerprints per leaf of the upper tree.
LEAF_SAMPLE = 32
#: Fingerprints in a leaf of a lower tree, compared directly.
LEAF_SIZE = 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of XXH64 (seed 42) over word shingles, as unsigned 64 bits; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    one = xxhash.xxh64_intdigest
    spans = zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    hashes = np.array([one(joined[a:b], 42) for a, b in spans], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 16384):
        part = hashes[at:at + 16384]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; ``fp`` is the fingerprint as a signed BIGINT."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])
    return rows.mapInArrow(mark, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


class Tree:
    """Vantage points as flat arrays. ``inside`` and ``outside`` are node numbers, or ~leaf."""

    def __init__(self, points: np.ndarray, leaf: int, bits: int):
        self.bits, self.points, self.radii, self.kids, self.leaves = bits, [], [], [], 0
        self.root = self._grow(points, leaf)

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        cut = choose(points, self.bits) if len(points) > leaf else None
        if cut is None:
            self.leaves += 1
            return ~(self.leaves - 1)
        vantage, radius, far = cut
        at = len(self.points)
        self.points.append(vantage)
        self.radii.append(radius)
        self.kids.append(None)
        self.kids[at] = (self._grow(points[far <= radius], leaf), self._grow(points[far > radius], leaf))
        return at

    def leaf_rows(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, points that belong to it or overlap its boundary)."""
        stack = [(self.root, points)]
        while stack:
            at, rows = stack.pop()
            if not len(rows):
                continue
            if at < 0:
                yield ~at, rows
                continue
            far = np.bitwise_count(rows ^ self.points[at])
            stack.append((self.kids[at][0], rows[far <= self.radii[at] + self.bits]))
            stack.append((self.kids[at][1], rows[far > self.radii[at]]))


def choose(points: np.ndarray, bits: int) -> tuple[np.uint64, int, np.ndarray] | None:
    """Vantage point and radius that leave few points on the boundary and both sides filled; None if nothing parts them.

    Candidates are spread evenly over the points as given, so the choice is the same whenever the rows are.
    """
    best = None
    for vantage in points[:: max(1, len(points) // 4)][:4]:
        far = np.bitwise_count(points ^ vantage)
        below = np.cumsum(np.bincount(far, minlength=65 + bits))
        for radius in range(64):
            inside, copied = int(below[radius]), int(below[radius + bits] - below[radius])
            less = min(inside, len(points) - inside)
            if less * 8 < len(points):
                continue
            cost = copied / less
            if best is None or cost < best[0]:
                best = (cost, vantage, radius, far)
    if best is None or best[0] >= 1.8:
        return None
    return best[1:]


def local_links(points: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among distinct points, as (low end, high ends) pieces per lower leaf."""
    found, stack = [], [(points, len(points) + 1)]
    while stack:
        rows, parent = stack.pop()
        if len(rows) < 2:
            continue
        cut = choose(rows, bits) if LEAF_SIZE < len(rows) < parent else None
        if cut is None:
            found += _links_directly(rows, bits)
            continue
        _, radius, far = cut
        stack.append((rows[far <= radius + bits], len(rows)))
        stack.append((rows[far > radius], len(rows)))
    return found


def _near_any(rows: np.ndarray, others: np.ndarray, bits: int, step: int = 512) -> np.ndarray:
    """Which of ``others`` are within ``bits`` of any of ``rows``, in blocks of bounded size."""
    hit = np.zeros(len(others), dtype=bool)
    for a in range(0, len(rows), step):
        for b in range(0, len(others), 4096):
            far = np.bitwise_count(rows[a:a + step, None] ^ others[None, b:b + 4096])
            hit[b:b + 4096] |= (far <= bits).any(axis=0)
    return hit


def _links_directly(rows: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    if len(rows) <= 1024:
        linked = ((np.bitwise_count(rows[:, None] ^ rows[None, :]) <= bits).sum(axis=1) > 1)
        rows = rows[linked]
    found, left = [], rows
    while len(left) > 1:
        front, left, group = left[:1], left[1:], [left[:1]]
        while len(front) and len(left):
            hit = _near_any(front, left, bits)
            front, left = left[hit], left[~hit]
            group.append(front)
        members = np.sort(np.concatenate(group))
        if len(members) > 1:
            found.append((np.repeat(members[:1], len(members) - 1), members[1:]))
    return found


def fingerprint_links(points: DataFrame, bits: int = LINK_BITS) -> DataFrame:
    """(a, b): links whose components are those of all pairs of ``points.fp`` within ``bits``.

    ``points`` has distinct BIGINT values in ``fp`` and is read three times, so hand over a written table.
    """
    spark, total = points.sparkSession, points.count()
    wanted = min(MAX_SAMPLE, max(MIN_SAMPLE, total // SAMPLE_STEP))
    share = min(1.0, wanted / max(total, 1))
    drawn = (points.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
             .select("fp").limit(2 * MAX_SAMPLE).toArrow().column("fp").to_numpy())
    tree = spark.sparkContext.broadcast(Tree(np.sort(drawn.view(np.uint64)), LEAF_SAMPLE, bits))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dealt = list(tree.value.leaf_rows(batch.column(0).to_numpy().view(np.uint64)))
            if dealt:
                shards = np.repeat([leaf for leaf, _ in dealt], [len(rows) for _, rows in dealt])
                fps = np.concatenate([rows for _, rows in dealt]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(fps)], ["shard", "fp"])

    def link(shard: pa.Table) -> pa.Table:
        rows = np.sort(shard.column("fp").to_numpy()).view(np.uint64)
        pairs = local_links(rows, bits) or [(np.empty(0, np.uint64),) * 2]
        ends = [pa.array(np.concatenate(side).view(np.int64)) for side in zip(*pairs)]
        return pa.Table.from_arrays(ends, names=["a", "b"])

    return (points.select("fp").mapInArrow(deal, "shard bigint, fp bigint").groupBy("shard")
            .applyInArrow(link, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = LINK_BITS) -> DataFrame:
    """(id, fp, component) for every row of ``docs``.

    ``component`` is the least id that can be reached over fingerprints differing in at most ``bits`` bits. Null
    and empty texts have fingerprint zero and link like any other. Repeated rows stay repeated and share a
    component. A null id never names a component unless all its members are null. An empty table gives no rows;
    columns other than id and text are not read. Texts are taken whole.
    """
    found = near_groups(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", bits)
    return found.select("id", "fp", "component")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = LINK_BITS) -> DataFrame:
    """(id, fp, component, root) as ``near_duplicates``; ``root`` tells groups apart that have no id."""
    marked = materialize(with_fingerprint(docs, id_col, text_col))
    points = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(fingerprint_links(points, bits), "a", "b")
    rooted = materialize(points.join(roots, points.fp == roots.node, "left")
                         .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    names = rooted.groupBy("root").agg(F.min("least").alias("component"))
    classes = rooted.join(names, "root").select("fp", "component", "root")
    return marked.join(classes, "fp").select("id", "fp", "component", "root")
