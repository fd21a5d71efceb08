"""Fuzzy line deduplication.

Lines are normalised and get a SimHash over their words. Two different lines are compared when their SimHashes differ in at
most ``BITS`` bits; cut into ``BLOCKS`` blocks, those agree in at least ``BLOCKS - BITS`` of them, so joining on every choice of that
many blocks finds all such pairs. A pair links when its edit similarity reaches ``SIMILAR``. Of each connected group
of lines one occurrence stays in all texts: the first by document id, then position.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cabledger.llm.components import components
from cabledger.llm.text_keys import let
from cabledger.session import materialize

BITS, BLOCKS, SIMILAR = 2, 4, 0.8
#: Edit distances tried with narrower bands before the full one, which costs length times distance, where that is much wider.
BANDS = 24, 64
#: Beginnings of so many characters, more or less than half alike, only tell which proof is tried first.
PROBE = 64
#: What parts words: runs of ASCII characters that are neither letters nor digits.
GAP = r"[\x00-/:-@\[-`{-\x7f]+"
#: Bits of a hash that one sum counts, in lanes (fixed values). A lane holds counts below a quarter of its range: one more bit takes
#: the comparison with half of the words, and the highest lane must not reach the sign.
LANES = {16: 0x0001000100010001, 32: 0x0000000100000001}
LONG_LINE = (1 << 14) - 1
#: What every part of a line carries with its sums.
LINE = ["row", "id", "th", "pos", "key", "size", "n"]
#: Words whose hashes are added up bit by bit before they reach the sums: as many as four binary digits count.
TOGETHER = 15


def words_of(line: Column) -> Column:
    """The words of a line in lower case; punctuation and white space part them, digits are kept."""
    return F.array_remove(F.split(F.lower(line), GAP), "")


def normalised(line: Column) -> Column:
    return F.array_join(words_of(line), " ")


def _block_masks(bits: int, blocks: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    each = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    signed = [sum(c) for c in combinations(each, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in signed]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    hashed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                         F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    return hashed.select("row", "id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _added(a: str, b: str, c: str) -> tuple[Column, Column]:
    """The sum of three bits, as its low and high bit, in each of 64 places."""
    x, y, z = F.col(a), F.col(b), F.col(c)
    return x.bitwiseXOR(y).bitwiseXOR(z), x.bitwiseAND(y).bitwiseOR(z.bitwiseAND(x.bitwiseOR(y)))


def _bit_counts(hashed: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the planes ``p0`` to ``p3``: in each place, the binary digits of how many of ``h0`` to ``h14`` have the bit."""
    planes, step = {0: [f"h{k}" for k in range(TOGETHER)]}, 0
    while any(len(same) > 1 for same in planes.values()):
        after, new = defaultdict(list), []
        for digit, same in planes.items():
            whole = len(same) // 3 * 3
            after[digit] += same[whole:]
            for i in range(0, whole, 3):
                for at, bit in zip((digit, digit + 1), _added(*same[i:i + 3])):
                    after[at].append(f"_{step}_{digit}_{i}_{at}")
                    new.append(bit.alias(after[at][-1]))
        kept = [c for digit, same in planes.items() for c in same[len(same) // 3 * 3:]]
        hashed, planes, step = hashed.select(*keep, *kept, *new), after, step + 1
    return hashed.select(*keep, *[F.col(c).alias(f"p{digit}") for digit, (c,) in sorted(planes.items())])


def _nibbles(planes: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``c0`` to ``c3``: the counts of the planes as four bits beside each other, those of every fourth place in one number."""
    def digit(k: int, r: int) -> Column:
        return F.shiftleft(F.shiftrightunsigned(f"p{k}", r).bitwiseAND(F.lit(0x1111111111111111)), k)
    return planes.select(*keep, *[reduce(lambda a, b: a.bitwiseOR(b), [digit(k, r) for k in range(4)]).alias(f"c{r}") for r in range(4)])


def _above_half(lane: int) -> Column:
    """The bits that more than half of ``n`` words have, of sums ``s0``, ``s1`` and so on in lanes of ``lane`` bits."""
    # What is missing to the highest count is added to all lanes at once, so that counts above half of the words carry into the next bit.
    missing = F.lit((1 << lane - 2) - 1) - F.shiftright("n", 1)

    def above(j: int) -> Column:
        carried = (F.col(f"s{j}") + missing * LANES[lane]).bitwiseAND(F.lit(LANES[lane] << lane - 2))
        return F.shiftrightunsigned(carried, lane - 2 - j) if j <= lane - 2 else F.shiftleft(carried, j - lane + 2)
    return reduce(lambda a, b: a.bitwiseOR(b), [above(j) for j in range(lane)])


def _counted(lines: DataFrame) -> DataFrame:
    """Lines given with their words, in parts of at most ``LONG_LINE`` words: what ``LINE`` names and ``fp``, or, for a line of several parts,
    16 sums ``s0`` to ``s15`` that count four bits each.

    Rows of one id and text are summed apart, so that repeats do not fill the lanes.
    """
    size = F.size("words")
    # The line's hash is taken below the explode; beside it, it would be taken once per row. The outer form keeps Spark
    # from cutting every line twice, to test for words first.
    groups = (lines.select("row", "id", "th", "pos", F.xxhash64("words").alias("key"), F.length(F.array_join("words", " ")).alias("size"), "words")
              .select(*LINE[:-1], "words", size.alias("n"), F.explode_outer(
                  F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(TOGETHER)))).alias("i")).filter("i is not null"))
    word = [F.get("words", F.col("i") + k) for k in range(TOGETHER)]
    part_words = LONG_LINE // TOGETHER * TOGETHER
    keep = [*LINE, "part"]
    hashed = groups.select(*LINE, F.expr(f"i div {part_words}").alias("part"), *[
        F.when(w.isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(w)).alias(f"h{k}") for k, w in enumerate(word)])
    counts = _nibbles(_bit_counts(hashed, keep), keep)

    def lanes(j: int) -> Column:
        return F.shiftrightunsigned(f"c{j % 4}", j - j % 4).bitwiseAND(F.lit(LANES[16] * 15))
    sums = counts.groupBy(*keep).agg(*[F.sum(lanes(j)).alias(f"s{j}") for j in range(16)])
    whole = F.col("n") <= part_words
    return sums.select(*LINE, F.when(whole, _above_half(16)).alias("fp"), *[F.when(~whole, F.col(f"s{j}")).alias(f"s{j}") for j in range(16)])


def _joined(parts: DataFrame) -> DataFrame:
    """The lines of several parts, with their ``fp``: their sums are added up in lanes of 32 bits."""
    def lanes(j: int) -> Column:
        return F.shiftrightunsigned(f"s{j % 16}", j - j % 16).bitwiseAND(F.lit(LANES[32] * 0xffff))
    return parts.groupBy(*LINE).agg(*[F.sum(lanes(j)).alias(f"s{j}") for j in range(32)]).select(*LINE, _above_half(32).alias("fp"))


def line_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, pos, key, size, fp) of every line that is not blank: hash of the text, position, hash of the line, its characters, SimHash.
    Written to the shared folder.

    A bit of the SimHash is set if more than half of the words have it. The hashes of ``TOGETHER`` words are added up first, in
    four planes of binary digits; sums then count several bits at once, in lanes of 16 bits, and Spark combines them before
    the shuffle. Lines of more words than such lanes count are summed in parts, and the parts in lanes of 32 bits.
    """
    lines = _lines(docs, id_col, text_col)
    parts = materialize(_counted(lines.select("row", "id", "th", "pos", words_of(F.col("line")).alias("words"))))
    columns = [*LINE[1:-1], "fp"]
    long = materialize(_joined(parts.filter("fp is null")).select(*columns))
    return parts.filter("fp is not null").select(*columns).unionByName(long)


def _most(a: Column, b: Column, least: float) -> Column:
    """The edit distance that lines of ``a`` and ``b`` characters may have."""
    return F.floor(F.greatest(a, b) * (1 - least) + 1e-9).cast("int")


def _sizes_near(a: str, b: str, least: float) -> Column:
    return F.abs(F.col(a) - F.col(b)) <= _most(F.col(a), F.col(b), least)


def shared_blocks(lines: DataFrame, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """(key, fp, t, v, head, head_fp): lines by choice of blocks ``t`` and their value ``v``, where several share them, with
    the least line of those. Two lines alone in a block are left out if they differ in more than ``bits`` bits. The ``size`` of the lines,
    if they have it, goes along, and the least line's as ``head_size``."""
    line = ["key", "fp", *[c for c in lines.columns if c == "size"]]
    masks = F.array(*[F.lit(m) for m in _block_masks(bits, blocks)])
    # One number stands for choice and value, as Spark sorts by one number far faster than by two. Should two blocks share it, they
    # are only kept together; pairs are of one block all the same.
    cut = lines.select(*line, F.posexplode(masks).alias("t", "mask")).select(
        *line, "t", F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("block"))
    together = Window.partitionBy("block")
    found = cut.withColumns({"n": F.count(F.lit(1)).over(together), "changed": F.bit_xor("fp").over(together)}).filter(
        (F.col("n") > 2) | ((F.col("n") == 2) & (F.bit_count("changed") <= bits)))
    return found.withColumn("first", F.min(F.struct(*line)).over(together)).select(
        *line, "t", F.col("fp").bitwiseAND(F.get(masks, "t")).alias("v"), F.col("first.key").alias("head"),
        *[F.col(f"first.{c}").alias(f"head_{c}") for c in line[1:]])


def met(shared: DataFrame, bits: int = BITS, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``shared`` that meet another line of their block in at most ``bits`` differing bits and of a size that leaves
    them similar: the others have no part in any link."""
    other = shared.select(*[F.col(c).alias(c + "_") for c in ("key", "fp", "t", "v", "size")])
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_"))) <= bits) & _sizes_near("size", "size_", similar)
    return shared.join(other, (F.col("t") == F.col("t_")) & (F.col("v") == F.col("v_")) & (F.col("key") != F.col("key_")) & near, "left_semi")


def head_pairs(shared: DataFrame, bits: int = BITS, similar: float = SIMILAR) -> DataFrame:
    """(a, b): every line with the least line of each of its blocks, if near enough and, where they have a ``size``, near enough in that;
    at most one pair per line and block."""
    near = (F.col("key") != F.col("head")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("head_fp"))) <= bits)
    if "size" in shared.columns:
        near &= _sizes_near("size", "head_size", similar)
    return shared.filter(near).select(F.col("head").alias("a"), F.col("key").alias("b")).distinct()


def cross_pairs(shared: DataFrame, bits: int = BITS, blocks: int = BLOCKS, similar: float = SIMILAR) -> DataFrame:
    """(a, b) of lines in one block whose ``fp`` differ in at most ``bits`` bits and whose ``group`` differs, each pair once; where lines have a
    ``size``, only those near enough in it."""
    a, b = (shared.select(*[F.col(c).alias(c + side) for c in ("key", "fp", "t", "v", "group", "size") if c in shared.columns]) for side in "ab")
    sizes = _sizes_near("sizea", "sizeb", similar) if "size" in shared.columns else F.lit(True)
    changed = F.col("fpa").bitwiseXOR(F.col("fpb"))
    # A pair that agrees in several choices of blocks is taken at the first of them.
    earlier = reduce(lambda x, y: x | y, [(F.col("ta") > i) & (changed.bitwiseAND(F.lit(m)) == 0)
                                          for i, m in enumerate(_block_masks(bits, blocks))])
    return (a.join(b, (F.col("ta") == F.col("tb")) & (F.col("va") == F.col("vb")) & (F.col("keya") < F.col("keyb"))
                   & (F.col("groupa") != F.col("groupb")) & (F.bit_count(changed) <= bits) & sizes & ~earlier)
            .select(F.col("keya").alias("a"), F.col("keyb").alias("b")))


def _equal_words(a: Column, b: Column) -> Column:
    """How many words two lists begin with alike."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(at == 0, F.size(a)).otherwise(at - 1).cast("int")


def _unlike(a: Column, b: Column) -> Column:
    """(a, b): two lists of words from the first word that differs to the last, a blank behind each; as far apart as the whole."""
    def part(words: Column, front: Column, back: Column) -> Column:
        size = F.size(words) - front - back
        return F.when(size == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(words, front + 1, size), " "), F.lit(" ")))

    def of(front: Column) -> Column:
        most = F.least(F.size(a), F.size(b)) - front
        return let(F.least(_equal_words(F.reverse(a), F.reverse(b)), most),
                   lambda back: F.struct(part(a, front, back).alias("a"), part(b, front, back).alias("b")))
    return let(_equal_words(a, b), of)


def _similar(a: str, b: str, least: float) -> Column:
    """Whether 1 - edit distance / longer length is at least ``least``."""
    most = _most(F.length(a), F.length(b), least)

    def near(x: Column, y: Column) -> Column:
        # Words that differ at the same place, in lines of as many words, bound the distance from above.
        changed = F.zip_with(F.split(x, " "), F.split(y, " "), lambda p, q: F.when(p == q, 0).otherwise(F.greatest(F.length(p), F.length(q))))
        same_size = F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) == F.length(y) - F.length(F.replace(y, F.lit(" "), F.lit("")))
        bound = F.aggregate(changed, F.lit(0), lambda total, c: total + c)
        short = F.least(F.length(x), F.length(y))

        def within(band: int) -> Column:
            return (most > band * 3 // 2) & (F.levenshtein(x, y, band) >= 0)
        # Beginnings that leave equally much of both lines are at most as far apart as the whole: what else the whole pays for ending
        # the first beginning elsewhere in the other line, the rests pay too. Lines that are not alike differ in more than five of
        # eight characters.
        begin = (most * 8 / 5 - F.abs(F.length(x) - F.length(y)) / 2).cast("int")
        apart = (begin * 4 <= short * 3) & (F.call_function(
            "levenshtein", F.left(x, begin + F.length(x) - short), F.left(y, begin + F.length(y) - short), most) < 0)
        full = F.call_function("levenshtein", x, y, most) >= 0
        alike = F.levenshtein(F.left(x, F.lit(PROBE)), F.left(y, F.lit(PROBE)), PROBE // 2) >= 0
        by_bands = F.when(within(BANDS[0]), F.lit(True)).when(within(BANDS[1]), F.lit(True)).otherwise(full)
        return (F.when(F.greatest(F.length(x), F.length(y)) <= most, F.lit(True)).when(same_size & (bound <= most), F.lit(True))
                .when(alike, by_bands).when(apart, F.lit(False)).otherwise(by_bands))
    words = F.struct(F.split(a, " ").alias("a"), F.split(b, " ").alias("b"))
    return F.when(F.abs(F.length(a) - F.length(b)) > most, F.lit(False)).otherwise(
        let(words, lambda w: let(_unlike(w["a"], w["b"]), lambda m: near(m["a"], m["b"]))))


def _line_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, norm) of the wanted lines, given as (key, first) with the place of one occurrence; each key once."""
    places = wanted.groupBy(F.col("first.id").alias("_id"), F.col("first.th").alias("_th")).agg(
        F.collect_list(F.struct(F.col("first.pos").alias("pos"), "key")).alias("_want"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    # Rows that repeat an id and text repeat the few lines wanted of it, which is cheaper to mend than to look for among all texts.
    return (rows.join(places, (F.col("th") == F.col("_th")) & F.col("id").eqNullSafe(F.col("_id")))
            .select(F.split("text", "\n").alias("lines"), "_want").select("lines", F.explode("_want").alias("w"))
            .select("w.key", F.get("lines", F.col("w.pos")).alias("line")).groupBy("key").agg(F.max("line").alias("line"))
            .select("key", normalised(F.col("line")).alias("norm")))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, blocks: int = BLOCKS,
                  similar: float = SIMILAR) -> DataFrame:
    """(id, th, dropped): per text with lines to drop, its id, the hash of its text and their positions."""
    hashes = line_hashes(docs, id_col, text_col)
    lines = materialize(hashes.groupBy("key").agg(F.min(F.struct("id", "pos", "th")).alias("first"), F.max("fp").alias("fp"),
                                                  F.max("size").alias("size"), F.count(F.lit(1)).alias("n")))
    shared = materialize(met(materialize(shared_blocks(lines, bits, blocks)), bits, similar))
    ends = shared.select("key").distinct()
    texts = materialize(_line_texts(docs, lines.select("key", "first").join(ends, "key"), id_col, text_col))
    # Comparing costs far more than its bytes tell, so the pairs are dealt over all tasks.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def links(pairs: DataFrame) -> DataFrame:
        return (pairs.join(texts.select(F.col("key").alias("a"), F.col("norm").alias("na")), "a")
                .join(texts.select(F.col("key").alias("b"), F.col("norm").alias("nb")), "b")
                .repartition(tasks).filter(_similar("na", "nb", similar)).select("a", "b"))

    def grouped(base: DataFrame, column: str, found: DataFrame) -> DataFrame:
        """``base`` with ``group``: the root of ``column``, or the column itself where it has no link; ``linked`` stays or becomes true with one."""
        linked = F.col("node").isNotNull() | (F.col("linked") if "linked" in base.columns else F.lit(False))
        return base.join(found, base[column] == found.node, "left").withColumns(
            {"_g": F.coalesce("root", column), "_l": linked}).drop("node", "root", "group", "linked").withColumnsRenamed({"_g": "group", "_l": "linked"})

    # Links to the least line of a block join most of what belongs together; the other pairs matter only between the
    # groups that come of it, so a large group of near copies never meets pair by pair.
    first = components(links(head_pairs(shared, bits, similar)), "a", "b")
    # Pairs with the least line of their block are settled.
    apart = materialize(grouped(shared.filter("key <> head").select("key", "fp", "size", "t", "v"), "key", first))
    names = apart.select("key", "group").distinct()
    across = links(cross_pairs(apart, bits, blocks, similar))
    bridges = across.join(names.select(F.col("key").alias("a"), F.col("group").alias("ga")), "a").join(
        names.select(F.col("key").alias("b"), F.col("group").alias("gb")), "b").select("ga", "gb").distinct()
    second = components(bridges, "ga", "gb")
    # A line that comes once and has no link stays; most lines are such, and go no further.
    rooted = materialize(grouped(grouped(lines.select("key", "first", "n"), "key", first), "group", second)
                          .filter("n > 1 or linked").select("key", "first", F.col("group").alias("root")))
    kept = rooted.groupBy("root").agg(F.min("first").alias("keep"))
    repeated = rooted.select("key", "root").join(kept, "root").select("key", "keep")
    return (hashes.join(repeated, "key").filter(~(F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("pos") == F.col("keep.pos"))
                                                  & (F.col("th") == F.col("keep.th"))))
            .groupBy("id", "th").agg(F.collect_set("pos").alias("dropped")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, blocks: int = BLOCKS,
                similar: float = SIMILAR) -> DataFrame:
    """``docs`` with all its rows and columns, the text without its dropped lines, plus ``n_lines`` and ``n_dropped``.

    Lines end at a line feed. Blank lines, and lines of punctuation only, are never dropped; lines that differ in numbers are different
    lines, compared like any others. The first
    occurrence is the least by id (null first), position and text hash; a text that loses all its lines becomes
    empty. A null text stays null, with no lines. Rows with equal id and text count as one document and are changed alike.
    An empty table gives no rows. Columns of ``docs`` named ``n_lines`` or ``n_dropped`` are replaced; others never clash.
    """
    drops = dropped_lines(docs, id_col, text_col, bits, blocks, similar).select(
        F.struct("id", "th", "dropped").alias("__line_drops"))
    found = F.col("__line_drops")
    joined = docs.join(drops, (F.xxhash64(docs[text_col]) == found["th"]) & docs[id_col].eqNullSafe(found["id"]), "left")
    joined = joined.withColumn("__line_cut", F.split(F.col(text_col), "\n"))   # by itself, so that a text is cut once
    lines = F.col("__line_cut")
    gone = F.coalesce(found["dropped"], F.array().cast("array<int>"))
    text = F.when(F.size(gone) == 0, F.col(text_col)).otherwise(
        F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(gone, i)), "\n"))
    out = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*out, F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"),
                         F.size(gone).cast("bigint").alias("n_dropped"))
