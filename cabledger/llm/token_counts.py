"""Token counts of whole texts without token ids: pieces per distinct pre-token, times how often it occurs.

The vocabulary pass counts the pieces of every distinct pre-token of the corpus once. The most frequent short ones
(``HEAD`` entries of at most ``HEAD_CHARS`` characters, so a proven bound) are broadcast, which keeps the hot
pre-tokens out of the join. Each document sums those at once and hands on only its rarer pre-tokens with
their frequencies, which are joined to the counted ones.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer, pre_tokenizers

from cabledger.llm.frequent import frequent_from
from cabledger.session import materialize

# Spark runs a task per core; threads of the library within a task would only take memory.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

HEAD, HEAD_CHARS = 1 << 17, 32
#: Distinct pre-tokens a task holds before it hands them on, those the library counts in one go, and characters of text per batch.
HELD, AT_ONCE, SLICE_CHARS = 1 << 16, 512, 1 << 20

# The rules of a file that lower-cases, drops white space and splits by letters, digits and others; and the characters
# for which the two patterns below do the same faster.
PLAIN_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PLAIN_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ×÷“”‘’–—…€]*")
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


class Splitter:
    """Pre-tokens of a text as the tokenizer file defines them, in their normalised spelling.

    The file must hold a BPE model whose text is cut by a byte-level step that adds no blank, and special tokens that are matched as
    written; other files are refused, since their pieces could depend on more than the pre-token.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        before = rules["pre_tokenizer"] or {}
        steps = before.get("pretokenizers", [before])
        added = rules["added_tokens"]
        odd = [t["content"] for t in added if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]]
        if (rules["model"]["type"] != "BPE" or rules["model"].get("dropout") or odd or steps[-1].get("type") != "ByteLevel"
                or any(s.get("type") not in ("Split", "ByteLevel") or s.get("add_prefix_space") for s in steps)):
            raise ValueError(f"{path}: counting by pre-token needs a byte-level BPE file with plain special tokens")
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.fast = rules["normalizer"] == PLAIN_NORMALIZER and steps[:-1] == [PLAIN_SPLIT] and not steps[-1]["use_regex"]
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def split(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens, special tokens found in the text)."""
        parts, found = [text], 0
        if self.special and (pieces := self.special.split(text)) and len(pieces) > 1:
            parts, found = pieces, len(pieces) - 1
        words: list[str] = []
        for part in parts:
            if self.fast and PLAIN.fullmatch(part):
                words += WORDS.findall(part.lower())
            else:
                normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                words += [normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return words, found

    def pieces(self, words: list[str]) -> list[int]:
        return [len(e) for at in range(0, len(words), AT_ONCE)
                for e in self.bare.encode_batch(words[at:at + AT_ONCE], add_special_tokens=False)]


@functools.lru_cache(maxsize=1)
def _splitter(path: str) -> Splitter:
    """One per Python worker: loading a file again for every task costs time and leaves memory in pieces."""
    return Splitter(path)


def vocabulary(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """(word, n, pieces): every distinct pre-token of the column ``text``, its frequency and its number of pieces."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, held = _splitter(tokenizer_path), Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(splitter.split(text.as_py() or "")[0])
                if len(held) >= HELD:
                    yield from flush(held)
        yield from flush(held)

    def flush(held: Counter) -> Iterator[pa.RecordBatch]:
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                             ["word", "n"])
            held.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter(tokenizer_path)
        for batch in batches:
            pieces = splitter.pieces(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], ["word", "n", "pieces"])
    return (texts.select("text").mapInArrow(gather, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
            .mapInArrow(count, "word string, n bigint, pieces bigint"))


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 head: int = HEAD) -> DataFrame:
    """(id, n_bytes, n_tokens) for every row of ``docs``, as the tokenizer counts the whole text.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids are counted each by itself. An empty
    table gives no rows; columns other than id and text are not read. ``tokenizer_path`` must be readable on every
    executor, like an installed package.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    Splitter(tokenizer_path)  # refuses a file that can't be counted by pre-token before any task starts
    words = materialize(vocabulary(rows, tokenizer_path))
    short = words.filter(F.length("word") <= HEAD_CHARS)
    top = short.filter(F.col("n") >= frequent_from(short, "n", head)).select("word", "pieces").toArrow()
    known = rows.sparkSession.sparkContext.broadcast(dict(zip(top.column("word").to_pylist(), top.column("pieces").to_pylist())))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, pieces = _splitter(tokenizer_path), known.value
        for batch in batches:
            start, held, sizes, sums, ends, rare, times = 0, 0, [], [], [0], [], []
            for i, cell in enumerate(batch.column(1)):
                text = cell.as_py() or ""
                found, specials = splitter.split(text)
                counts = [pieces.get(w, 0) for w in found]
                sizes.append(len(text.encode()))
                sums.append(sum(counts) + specials)
                rest = Counter(w for w, k in zip(found, counts) if not k)
                rare += rest.keys()
                times += rest.values()
                ends.append(len(rare))
                held += len(text)
                if held >= SLICE_CHARS or i + 1 == batch.num_rows:
                    pairs = pa.StructArray.from_arrays([pa.array(rare, pa.string()), pa.array(times, pa.int64())], ["word", "n"])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, len(sizes)), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()),
                         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["id", "n_bytes", "known", "rest"])
                    start, held, sizes, sums, ends, rare, times = i + 1, 0, [], [], [0], [], []
    kind = rows.schema["id"].dataType.simpleString()
    tallied = materialize(
        rows.mapInArrow(tally, f"id {kind}, n_bytes bigint, known bigint, rest array<struct<word string, n bigint>>")
        .withColumn("row", F.monotonically_increasing_id()))
    rest = tallied.select("row", F.explode("rest").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    sums = rest.join(words.select("word", "pieces"), "word").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    return (tallied.select("row", "id", "n_bytes", "known").join(sums, "row", "left")
            .select("id", "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens")))
