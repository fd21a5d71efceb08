"""Benchmark decontamination by winnowed word k-grams.

A window of ``window`` words holds ``WINDOW_HASHES`` word k-grams. Winnowing keeps the least k-gram hash of every such
window, in documents and items alike, so an occurrence of an item's window always shares a kept hash with the item.
Kept hashes are joined; a hit is then extended to the windows around it, which are compared as text. Items
shorter than a window are one window of their own length, found by the hash of every word sequence of that length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cabledger.llm.text_keys import lower_ascii, text_key
from cabledger.session import materialize

WINDOW, GRAM = 10, 5
#: Words (fixed pattern): digits, lower-case letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Low bits of a kept value that hold the position within a window; the hash is what stands above them.
PLACE_BITS = 24
PLACES = (1 << PLACE_BITS) - 1


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def _upto(last: Column) -> Column:
    """0..last, empty when last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def with_kept(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``rows`` with ``kept``: an array of (at, h), word position and hash of every kept k-gram of ``words``.

    The least hash of each window is kept, the rightmost of equal ones. A value is hash above place; the place is
    taken modulo 2**24 and read back relative to its window, so texts may be of any length.
    """
    each = window - gram + 1
    hashed = rows.withColumn("_g", F.when(F.size("words") >= window, F.transform(
        _upto(F.size("words") - gram), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(gram)])
        .bitwiseAND(F.lit(~PLACES)).bitwiseOR(F.lit(PLACES) - i.cast("bigint").bitwiseAND(F.lit(PLACES)))))
        .otherwise(F.array().cast("array<bigint>")))
    found = hashed.withColumn("_at", F.array_distinct(F.transform(
        _upto(F.size("_g") - each),
        lambda i: i + F.pmod(F.lit(PLACES) - F.array_min(F.slice("_g", i + 1, each)).bitwiseAND(F.lit(PLACES)) - i,
                             F.lit(PLACES + 1)).cast("int"))))
    return found.withColumn("kept", F.transform("_at", lambda i: F.struct(
        i.alias("at"), F.shiftright(F.get("_g", i), PLACE_BITS).alias("h")))).drop("_g", "_at")


def winnowed(marked: DataFrame) -> DataFrame:
    """(key, key64, at, h) per kept k-gram."""
    return marked.select("key", "key64", F.explode("kept").alias("_f")).select("key", "key64", "_f.at", "_f.h")


def _sequences(rows: DataFrame, length: int) -> DataFrame:
    """(key, key64, at, h) of every sequence of ``length`` words."""
    return rows.select("key", "key64", F.explode(F.transform(_upto(F.size("words") - length), lambda i: F.struct(
        i.alias("at"), F.xxhash64(*[F.get("words", i + j) for j in range(length)]).alias("h")))).alias("_f")).select(
        "key", "key64", "_f.at", "_f.h")


def marked_texts(docs: DataFrame, text_col: str, keep: list[Column], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, the text's keys, its number of words and its kept k-grams.

    Written once, so whole texts are cut into words a single time.
    """
    rows = docs.select(*keep, text_key(F.col(text_col)).alias("key"), F.xxhash64(F.col(text_col)).alias("key64"),
                       words_of(F.col(text_col)).alias("words"))
    return materialize(with_kept(rows, window, gram).withColumn("n_words", F.size("words").cast("bigint")).drop("words"))


def contaminated_texts(marked: DataFrame, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                       item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, n_hit, items): for each distinct text with a hit, its words hit and the sorted ids (as strings) of its items.

    ``marked`` is ``marked_texts`` of ``docs``; ``key`` is ``text_key`` of the text. Texts without a hit are not listed.
    """
    if not 1 <= gram <= window:
        raise ValueError("a k-gram must fit into a window")
    items = materialize(benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(item_text)).alias("words"))
                        .filter(F.size("words") > 0).withColumn("len", F.least(F.size("words"), F.lit(window))))
    shorts = sorted(r.len for r in items.filter(F.col("len") < window).select("len").distinct().collect())
    spans = materialize(items.select("item", "len", F.explode(F.transform(
        _upto(F.size("words") - F.col("len")),
        lambda i: F.array_join(F.slice("words", i + 1, F.col("len")), " "))).alias("span")).distinct())

    as_rows = items.select(F.lit("").alias("key"), F.lit(0).alias("key64"), "words", "len")
    marks = materialize(winnowed(with_kept(as_rows, window, gram)).select("h").distinct())
    hits = winnowed(marked).join(
        marks, "h", "left_semi").select("key", "key64", (F.col("at") - (window - gram)).alias("first"), F.col("at").alias("last"),
                                        F.lit(window).alias("len"))
    for length in shorts:
        rows = docs.select(text_key(F.col(text_col)).alias("key"), F.xxhash64(F.col(text_col)).alias("key64"),
                           words_of(F.col(text_col)).alias("words"))
        own = materialize(_sequences(as_rows.filter(F.col("len") == length), length).select("h").distinct())
        hits = hits.unionByName(_sequences(rows, length).join(own, "h", "left_semi").select(
            "key", "key64", F.col("at").alias("first"), F.col("at").alias("last"), F.lit(length).alias("len")))
    hits = materialize(hits.groupBy("key", "key64").agg(F.collect_set(F.struct("first", "last", "len")).alias("hits")))

    # The short key only narrows the texts that are read again; the long one decides.
    texts = (docs.select(F.xxhash64(F.col(text_col)).alias("key64"), F.col(text_col).alias("_text"))
             .join(hits.select("key64").distinct(), "key64", "left_semi")
             .groupBy(text_key(F.col("_text")).alias("key")).agg(F.max("_text").alias("_text")))
    whole = texts.join(hits, "key").select("key", "hits", words_of(F.col("_text")).alias("words"))
    tried = whole.select("key", "words", F.explode(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(
        F.sequence(F.greatest(h["first"], F.lit(0)), h["last"]), lambda i: F.struct(i.alias("at"), h["len"].alias("len")))))))
        .alias("t"))
    tried = tried.filter(F.col("t.at") + F.col("t.len") <= F.size("words")).select(
        "key", "t.at", "t.len", F.array_join(F.slice("words", F.col("t.at") + 1, F.col("t.len")), " ").alias("span"))
    found = materialize(tried.join(spans, ["len", "span"]).select("key", "at", "len", "item"))
    covered = (found.select("key", "at", "len").distinct().groupBy("key").agg(F.size(F.array_distinct(F.flatten(F.collect_list(
        F.sequence(F.col("at"), F.col("at") + F.col("len") - 1))))).cast("bigint").alias("n_hit")))
    named = found.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return covered.join(named, "key")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, items, contaminated) for every row of ``docs``.

    A word is hit when it lies in an occurrence of ``window`` consecutive words of an item, or of a whole item that is
    shorter. Null and empty texts have no words and no hits, items without words match nothing, items with a null
    id hit but are not named. Repeated rows are kept and judged alike. Empty tables give no rows or no hits; other
    columns are not read.
    """
    marked = marked_texts(docs, text_col, [F.col(id_col).alias("id")], window)
    hit = contaminated_texts(marked, docs, benchmark, text_col, item_id, item_text, window)
    return marked.select("id", "key", "n_words").join(hit, "key", "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                      item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has no hit."""
    key = F.struct(text_key(F.col(text_col)).alias("key"))
    marked = marked_texts(docs, text_col, [], window)
    hit = contaminated_texts(marked, docs, benchmark, text_col, item_id, item_text, window).select(F.struct("key").alias("__hit_key"))
    return docs.join(hit, key == F.col("__hit_key"), "left_anti").select(*docs.columns)
