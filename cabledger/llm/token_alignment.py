"""Alignment of a byte-level tokenizer (A) with a sentencepiece model (B) over whole texts.

Both read the text behind one space. The spans the libraries report are coarse cuts: A's are characters, B's give
all bytes of a split character to its last piece and don't see the space that B adds. Wherever a span is not as wide
as its token, the cut is refined with the bytes that the token stands for. Bytes where tokens of A and of B both
end cut the text into groups, and every A token of a group is linked with every B token of it.

Where the files show that neither tokenizer joins a visible character with a following blank, tab or line feed, a text
is cut there, and each distinct segment is aligned once per task as long as it is remembered; new segments
are aligned many at a time, in a row.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as piece_files
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from cabledger.llm.frequent import frequent_from
from cabledger.session import materialize

#: Id pairs that are sent to every task with their counts, at most.
HEAD = 1 << 18
#: Characters of text handled before a batch is handed on, and links beyond which a group is counted by distinct ids.
SLICE_CHARS, WIDE = 1 << 20, 1 << 12
#: Segments remembered by a task (twice as many at most), longest one, and characters of new ones aligned in a row.
REMEMBERED, SEGMENT_CHARS, ROW_CHARS = 1 << 18, 64, 1 << 16
#: Links gathered before a task adds up their documents.
GATHER = 1 << 20


#: A segment ends before a blank, tab or line feed that follows a visible character.
SEGMENT = re.compile(r"\s*+\S++(?:[^\S \t\n]\s*+\S*+)*+|\s++")
#: Pieces that don't reach over the end of a segment.
WITHIN = re.compile("▁*[^▁ \t\n]*")


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte, turned round: printable bytes stand for themselves,
    the others follow from U+0100 in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class _Names:
    """Ids as text with what may follow them, for the listing of groups."""

    def __init__(self, size: int, end: str):
        self.comma = np.array([f"{i}," for i in range(size)], object)
        self.last = np.array([f"{i}{end}" for i in range(size)], object)

    def of(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        return np.where(last, self.last[ids], self.comma[ids])


def _refined(begins: np.ndarray, ends: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Byte ends: reported where a span is as wide as its token, else counted on from the last such token."""
    total = np.cumsum(widths)
    exact = np.where(ends - begins == widths, np.arange(len(ends)), -1)
    base = np.maximum.accumulate(exact)
    start = np.where(base < 0, 0, ends[base] - total[base])
    return start + total


class ByteLevel:
    """Tokens of a byte-level BPE file with their byte ends."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        size = self.tokenizer.get_vocab_size()
        entries = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(letters[c] for c in e) if all(c in letters for c in e) else e.encode() for e in entries]
        self.widths = np.array([len(b) for b in self.bytes], np.int64)
        self.names = _Names(size, "|")
        rules = json.loads(self.tokenizer.to_str())
        before = rules["pre_tokenizer"] or {}
        #: Whether segments can be handled one by one.
        self.segments = (rules["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex")
                         and not before.get("add_prefix_space"))

    def ends(self, text: str, raw: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, byte ends), or None if the tokens don't spell ``text``."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        if b"".join(map(self.bytes.__getitem__, found.ids)) != raw:
            return None
        ids = np.array(found.ids, np.int64)
        spans = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        if len(raw) != len(text):
            chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            place = np.concatenate([[0], np.cumsum(1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF))])
            spans = place[spans]
        return ids, _refined(spans[:, 0], spans[:, 1], self.widths[ids])


class Pieces:
    """Tokens of a sentencepiece model with their byte ends."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.bytes = [bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i)
                      else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(size)]
        self.widths = np.array([len(b) for b in self.bytes], np.int64)
        self.names = _Names(size, ";")
        file = piece_files.ModelProto()
        with open(path, "rb") as f:
            file.ParseFromString(f.read())
        rules = file.normalizer_spec
        self.segments = (not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.add_dummy_prefix
                         and rules.escape_whitespaces and not file.trainer_spec.treat_whitespace_as_suffix
                         and all(WITHIN.fullmatch(p.piece) for p in file.pieces))

    def ends(self, text: str, raw: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, byte ends within space and text), or None if the pieces don't spell them."""
        found = self.model.encode(text, return_type="proto").pieces
        spans = np.fromiter((n for p in found for n in (p.id, p.begin, p.end)), np.int64, 3 * len(found)).reshape(-1, 3)
        ids = spans[:, 0]
        if b"".join(map(self.bytes.__getitem__, ids.tolist())) != raw:
            return None
        return ids, _refined(spans[:, 1] + 1, spans[:, 2] + 1, self.widths[ids])


#: What is known of a text or segment: tokens of A, of B, groups, links, listing, linked pairs, how often each (None: once).
#: The last two are the bytes of 64-bit integers.
Found = tuple[int, int, int, int, str, bytes, bytes | None]
NOTHING: Found = (0, 0, 0, 0, "", b"", None)


class Aligner:
    """Groups and links of texts."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteLevel(byte_path), Pieces(piece_path)
        self.size_b = len(self.b.bytes)
        self.segments = self.a.segments and self.b.segments
        self.young: dict[str, Found | None] = {}
        self.old: dict[str, Found | None] = {}

    def in_a_row(self, segments: list[str]) -> list[Found | None] | None:
        """Each segment's tokens and links, None if they don't spell the text that the segments make in a row. It begins with a blank."""
        text = "".join(segments)
        raw = text.encode()
        one, two = self.a.ends(text, raw), self.b.ends(text[1:], raw)
        if one is None or two is None:
            return None
        (a, end_a), (b, end_b) = one, two
        cut_a, cut_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        n_a, n_b = np.bincount(group_a), np.bincount(group_b)
        past_a, past_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        links = n_a * n_b
        listed = np.empty(len(a) + len(b), object)
        listed[np.arange(len(a)) + past_b[group_a]] = self.a.names.of(a, cut_a)
        listed[np.arange(len(b)) + past_a[group_b + 1]] = self.b.names.of(b, cut_b)
        wide = links > WIDE
        plain = ~wide[group_a]
        codes = self.linked(a[plain], b, group_a[plain], past_b, n_b)
        sizes = [len(s.encode()) for s in segments]
        group = np.concatenate([[0], np.searchsorted(end_a[cut_a], np.cumsum(sizes)) + 1])
        at_a, at_b, at_link, at_code = (p[group].tolist() for p in (past_a, past_b, *(
            np.concatenate([[0], np.cumsum(n)]) for n in (links, np.where(wide, 0, links)))))
        listed, found = listed.tolist(), []
        for i, groups in enumerate(np.diff(group).tolist()):
            a0, a1, b0, b1 = at_a[i], at_a[i + 1], at_b[i], at_b[i + 1]
            found.append((a1 - a0, b1 - b0, groups, at_link[i + 1] - at_link[i], "".join(listed[a0 + b0:a1 + b1])[:-1],
                          codes[at_code[i]:at_code[i + 1]].tobytes(), None))
        for g in np.flatnonzero(wide).tolist():
            i = int(np.searchsorted(group, g, "right")) - 1
            *counts, flat, times = found[i]
            flat = np.frombuffer(flat, np.int64)
            times = np.ones(len(flat), np.int64) if times is None else np.frombuffer(times, np.int64)
            more = self.product(a[past_a[g]:past_a[g + 1]], b[past_b[g]:past_b[g + 1]])
            found[i] = (*counts, *(np.concatenate(p).tobytes() for p in zip((flat, times), more)))
        return found

    def each(self, segments: list[str]) -> list[Found | None]:
        """Each segment's tokens and links, None for one that they don't spell."""
        if segments[0][0] == " " and len(segments[0]) > 1:
            found = self.in_a_row(segments)
        else:  # B puts a blank before a text, so one that begins otherwise follows a word
            found = (self.in_a_row([" a", *segments]) or [None])[1:]
        if found:
            return found
        if len(segments) == 1:
            return [None]
        half = len(segments) // 2
        return self.each(segments[:half]) + self.each(segments[half:])

    def linked(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, past_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """All links in order as ``a * size of B + b``."""
        reps = n_b[group_a]
        within = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        return np.repeat(a, reps) * self.size_b + b[np.repeat(past_b[group_a], reps) + within]

    def product(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct links of one group by the distinct ids of both sides, and how often each occurs."""
        (x, nx), (y, ny) = (np.unique(v, return_counts=True) for v in (a, b))
        return (x[:, None] * self.size_b + y[None, :]).ravel(), (nx[:, None] * ny[None, :]).ravel()

    def resolve(self, wanted: set[str]) -> dict[str, Found | None]:
        """What is known of each segment; new ones are aligned and remembered."""
        known = {s: self.young[s] for s in wanted & self.young.keys()}
        again = {s: self.old[s] for s in (wanted & self.old.keys()) - known.keys()}
        known |= again
        self.young |= again
        new, row, chars = [], [], 0
        for s in wanted - known.keys():
            if len(s) <= SEGMENT_CHARS and not s[-1].isspace():
                row.append(s)
                chars += len(s)
                if chars >= ROW_CHARS:
                    new.append(row)
                    row, chars = [], 0
            else:
                new.append([s])
        for row in [*new, row]:
            if row:
                found = dict(zip(row, self.each(row)))
                known |= found
                self.young |= {s: f for s, f in found.items() if len(s) <= SEGMENT_CHARS}
        if len(self.young) >= REMEMBERED:
            self.young, self.old = {}, self.young
        return known

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """(tokens of A, of B, groups, links, groups as ``a1,a2|b1;a3|b2,b3``, linked pairs, how often) of each text."""
        cut = [(SEGMENT.findall(" " + t) if self.segments else [" " + t]) if t else [] for t in texts]
        known = self.resolve({s for segments in cut for s in segments})
        return [self.whole([known[s] for s in segments]) for segments in cut]

    def whole(self, parts: list[Found | None]) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        if not parts or None in parts:
            parts = [NOTHING]
        a, b, groups, links, listing, codes, times = zip(*parts)
        n = [np.frombuffer(t, np.int64) if t is not None else np.ones(len(c) // 8, np.int64) for c, t in zip(codes, times)] if any(
            t is not None for t in times) else None
        flat = np.frombuffer(b"".join(codes), np.int64)
        distinct = np.unique(flat, return_counts=True) if n is None else summed(flat, np.concatenate(n))
        return sum(a), sum(b), sum(groups), sum(links), ";".join(listing), *distinct


@functools.lru_cache(maxsize=1)
def _aligner(byte_path: str, piece_path: str) -> Aligner:
    """One per Python worker, so that later tasks of it know the segments of earlier ones."""
    return Aligner(byte_path, piece_path)


def summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(codes, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, where, times)
    return found, total


GROUPS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, codes array<bigint>, times array<bigint>"


def token_groups(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, codes, times) for every row of ``docs``.

    ``groups`` lists the ids as ``a1,a2|b1;a3|b2,b3`` in order; ``codes`` holds the distinct linked pairs as
    A id * size of B + B id, and ``times`` how often each is linked in the text. Texts that are null or empty, or that
    either tokenizer does not spell back, have zeros, an empty listing and no links.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_path, piece_path)

        def out(ids: pa.Array, found: list) -> pa.RecordBatch:
            columns = list(zip(*found))
            ends = np.concatenate([[0], np.cumsum([len(c) for c in columns[5]])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, np.concatenate(columns[i])) for i in (5, 6)]
            return pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()), *lists],
                ["id", *(f.split()[0] for f in GROUPS.split(", "))])

        for batch in batches:
            start, texts, held = 0, [], 0
            for i, cell in enumerate(batch.column(1)):
                texts.append(cell.as_py())
                held += len(texts[-1] or "")
                if held >= SLICE_CHARS or i + 1 == batch.num_rows:
                    yield out(batch.column(0).slice(start, len(texts)), aligner.align(texts))
                    start, texts, held = i + 1, [], 0
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {GROUPS}")


def link_counts(groups: DataFrame, size_b: int) -> DataFrame:
    """(code, n, best): in how many rows of ``token_groups`` a pair is linked, and whether no pair of its A id is in more."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], ["code", "n"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
            size += len(held[-1])
            if size >= GATHER:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()
    counts = materialize(groups.select("codes").mapInArrow(gather, "code bigint, n bigint")
                         .groupBy("code").agg(F.sum("n").alias("n")))
    a = F.expr(f"code div {size_b}").alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def link_sums(groups: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """``groups`` with n_best (links whose pair is its A id's best) and count_sum (counts over all links) in place of the links.

    ``groups`` has a number ``row`` per row beside the columns of ``token_groups``. The most frequent pairs, at most
    ``head``, are sent to every task; only the rarer ones of each text are joined. Both tables are read more than
    once, so hand over written ones.
    """
    top = counts.filter(F.col("n") >= frequent_from(counts, "n", head)).toArrow().sort_by("code")
    known = groups.sparkSession.sparkContext.broadcast(
        tuple(top.column(c).to_numpy().astype(np.int64) for c in ("code", "n", "best")))
    plain = [c for c in groups.columns if c not in ("codes", "times")]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counted, best = known.value
        for batch in batches:
            lists = batch.column("codes"), batch.column("times")
            ends = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            code, times = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
            hit, n, good = np.zeros(len(code), bool), np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
            if len(codes):
                place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = codes[place] == code
                n, good = np.where(hit, counted[place], 0), np.where(hit, best[place], 0)
            sums = [np.concatenate([[0], np.cumsum(times * v)])[ends] for v in (good, n)]
            missed = np.concatenate([[0], np.cumsum(~hit)])[ends].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in plain), *(pa.array(np.diff(s)) for s in sums),
                 *(pa.ListArray.from_arrays(missed, v[~hit]) for v in (code, times))],
                [*plain, "n_best", "count_sum", "rest", "rest_times"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.select(plain).schema)
    tallied = materialize(groups.mapInArrow(
        tally, f"{kinds}, n_best bigint, count_sum bigint, rest array<bigint>, rest_times array<bigint>"))
    rest = (tallied.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("r"))
            .select("row", F.col("r.rest").alias("code"), F.col("r.rest_times").alias("times")))
    more = rest.join(counts, "code").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    sums = [(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return tallied.join(more, "row", "left").select(*(c for c in plain if c != "row"), *sums)


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
          digest: bool = False, head: int = HEAD) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) for every row of ``docs``.

    With ``digest`` the listing is replaced by its SHA-256 (empty where there are no tokens) before anything is
    written. Null ids and repeated rows are rows of their own, also in the counts of documents; an empty table gives no rows;
    other columns are not read. The paths must be readable on every executor, like an installed package.
    """
    found = token_groups(docs, byte_path, piece_path, id_col, text_col)
    if digest:
        found = found.withColumn("groups", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()))
    size_b = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    return link_sums(found, materialize(link_counts(found, size_b)), head)
