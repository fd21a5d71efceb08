"""SimHash groups, components and line deduplication against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from cabledger.llm import line_dedup, simhash
from cabledger.llm.components import components
from llm_fixtures import docs_of, documents  # noqa: F401


def groups(frame):
    return sorted([(r.id, r.fp % (1 << 64), r.component) for r in frame.collect()], key=repr)


def test_simhash_equals_brute_force(documents):
    rows = [tuple(r) for r in documents.collect()]
    assert groups(simhash.near_duplicates(documents)) == brute.simhash_groups(rows)


def test_simhash_odd_rows(docs_of):
    long = "one two three four five " * 20_000
    rows = [(None, None), (3, ""), (2, " \t\n"), (5, "One TWO"), (6, "one two"), (6, "one two"), (7, long), (None, long + "x"), (8, "É b c")]
    frame = docs_of([(*r, "x", 1) for r in rows], ", fp string, id int")
    assert groups(simhash.near_duplicates(frame)) == brute.simhash_groups(rows)
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for s in seeds for _ in range(40)]
    points = np.unique(np.array(near + list(rng.integers(0, 1 << 63, 2000, dtype=np.uint64)), dtype=np.uint64))
    far = np.bitwise_count(points[:, None] ^ points[None, :])
    pairs = {(a, b) for a, b in zip(*np.nonzero(far <= 2)) if a < b}
    tree = simhash.Tree(points[::7], 16, 2)
    met = set()
    for _, rows in tree.leaf_rows(points):
        at = np.searchsorted(points, np.sort(rows))
        met |= {(a, b) for i, a in enumerate(at) for b in at[i + 1:]} & pairs
    assert met == pairs
    want, got = brute.Groups(range(len(points))), brute.Groups(range(len(points)))
    for a, b in pairs:
        want.join(a, b)
    for low, high in simhash.local_links(points, 2):
        for a, b in zip(np.searchsorted(points, low), np.searchsorted(points, high)):
            got.join(int(a), int(b))
    assert [want.find(i) for i in range(len(points))] == [got.find(i) for i in range(len(points))]


@pytest.mark.parametrize("kind", ["path", "random", "star"])
def test_components(spark, kind):
    rng = random.Random(2)
    edges = {"path": [(i, i + 1) for i in range(300)], "star": [(0, i) for i in range(1, 200)] + [(500, 501)],
             "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]}[kind]
    want = brute.Groups(range(600))
    for a, b in edges:
        want.join(a, b)
    found = components(spark.createDataFrame(edges + [(None, 3)], "a bigint, b bigint"), "a", "b")
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.root for r in found.collect()} == {x: want.find(x) for x in linked}


def test_lines_equal_brute_force(documents):
    rows = [tuple(r) for r in documents.filter("length(text) < 6000").collect()]
    frame = documents.filter("length(text) < 6000")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()}
    assert got == dict(brute.dedup_lines(rows))


def test_lines_odd_rows(docs_of):
    base = "the quick brown fox jumps over the lazy dog and runs far away into the dark green forest of tall old trees"
    rows = [(None, None), (1, ""), (2, "a b c\n\nA  b, c!\n\n"), (3, "...\n12\n***\n..."), (4, base), (5, base.replace("trees", "tree")),
            (6, "Page 1 of 9\nx"), (7, "page 22 of 10"), (13, "Total: 1,234,567"), (14, "total 9"), (15, "TOTAL: 9!"), (16, "12\n12 13"), (8, "a b a " * 24_000), (9, "a b a " * 24_000 + "\nlast"), (10, "w" * 9_000), (12, "no\u00a0break \x01 x")]
    frame = docs_of([(*r, "x", 1) for r in rows], ", n_lines string, key int")
    found = line_dedup.dedup_lines(frame)
    assert set(found.columns) == {"doc_id", "text", "n_lines", "key", "n_dropped"}
    assert {r.doc_id: r.text for r in found.collect()} == dict(brute.dedup_lines(rows))
    same = docs_of([(1, "only line"), (1, "only line"), (2, "only line")])
    assert sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(same).collect()) == [(1, "only line"), (1, "only line"), (2, "")]
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


def test_candidate_pairs_are_all_pairs_within_two_bits(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 20)
    fps = [int(s) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for s in seeds for _ in range(8)]
    shared = line_dedup.shared_blocks(spark.createDataFrame(list(enumerate(fps)), "key bigint, fp bigint"))
    got = [(r.a, r.b) for r in line_dedup.cross_pairs(shared.withColumn("group", F.col("key"))).collect()]
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == want
    assert {(r.a, r.b) for r in line_dedup.head_pairs(shared).collect()} <= want


def test_hashes_count_every_word(docs_of):
    text = " ".join(f"w{chr(97 + i % 7)}{chr(97 + i // 7 % 26)}" for i in range(400))
    row = line_dedup.line_hashes(docs_of([(1, text)]), "doc_id", "text").select(F.hex("fp")).first()[0]
    import xxhash
    assert int(row, 16) == brute.majority([xxhash.xxh64_intdigest(w.encode(), 42) for w in text.split(" ")])


def test_repeated_rows_do_not_fill_the_lanes(spark):
    words = [f"w{chr(97 + i)}" for i in range(10)]
    text = " ".join(["aa", "bb"] * 200 + ["cc"])   # more words than narrow lanes hold, in a line of its own
    assert int(line_dedup.line_hashes(spark.createDataFrame([(1, "x\n" + text)], "doc_id long, text string"), "doc_id", "text")
               .filter("pos = 1").select(F.hex("fp")).first()[0], 16) == brute.majority([brute.xxhash.xxh64_intdigest(w.encode(), 42) for w in text.split()])
    docs = spark.range(0, 14_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(" ".join(words)).alias("text"))
    found = line_dedup.line_hashes(docs, "doc_id", "text").select(F.hex("fp")).distinct().collect()
    import xxhash
    assert [int(r[0], 16) for r in found] == [brute.majority([xxhash.xxh64_intdigest(w.encode(), 42) for w in words])]


def test_hashes_of_every_number_of_words(docs_of):
    """Words are added up in groups of seven and compared with half of the words by carries: every remainder, and the widths of the lanes."""
    rng = random.Random(5)
    rows = [(n, " ".join(f"v{rng.randrange(50)}" for _ in range(n))) for n in [*range(1, 40), 16_382, 16_383, 16_384, 33_000]]
    got = {r.id: int(r[1], 16) for r in line_dedup.line_hashes(docs_of(rows), "doc_id", "text").select("id", F.hex("fp")).collect()}
    assert got == {i: brute.majority([brute.xxhash.xxh64_intdigest(w.encode(), 42) for w in text.split()]) for i, text in rows}


def test_lines_of_repeated_rows(docs_of):
    """A row that comes many times gives each of its lines once to the comparison, and all its rows change alike."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    rows = [(1, base)] * 30 + [(2, base + "\nother")] * 30 + [(3, base.replace("nine", "nime"))] * 30 + [(None, "other")] * 5
    want = dict(brute.dedup_lines(list(dict.fromkeys(rows))))
    texts = line_dedup._line_texts(docs_of(rows), line_dedup.line_hashes(docs_of(rows), "doc_id", "text").groupBy("key").agg(
        F.min(F.struct("id", "pos", "th")).alias("first")), "doc_id", "text").collect()
    assert len(texts) == len({r.key for r in texts}) == 3
    found = line_dedup.dedup_lines(docs_of(rows)).collect()
    assert len(found) == len(rows) and all(r.text == want[r.doc_id] for r in found)


def test_similar_lines_by_their_unlike_part(spark):
    """Only what lies between the first and the last word that differ is compared, and far beginnings settle long lines."""
    rng = random.Random(11)
    pairs = [("a b", "a b c"), ("a b c", "b c"), ("a", "b"), ("a a a a", "a a a"), ("é b c d", "é x c d"), ("b a b a b", "b a b")]
    for n in (5, 12, 40, 120):
        for changes in (1, 3, n // 3, n):
            words = [rng.choice("the of and tion erent nññt xx".split()) + rng.choice("abcd") for _ in range(n)]
            other = list(words)
            for _ in range(changes):
                at = rng.randrange(len(other))
                other[at:at + 1] = rng.choice([[], [other[at], "new"], ["other"], [other[at][:-1] + "z"]])
                other = other or ["w"]
            pairs += [(" ".join(words), " ".join(other)), (" ".join(words), " ".join(rng.sample(words, n)))]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, na string, nb string")
    split = [F.split(c, " ") for c in ("na", "nb")]
    got = frame.select("i", line_dedup._similar("na", "nb", 0.8).alias("near"), line_dedup._unlike(*split).alias("part")).orderBy("i").collect()
    for (a, b), r in zip(pairs, got, strict=True):
        far = brute.distance(a, b)
        assert far == brute.distance(r.part.a, r.part.b)
        assert r.near == (far <= int(max(len(a), len(b)) * 0.2 + 1e-9)), (a, b)
    assert (got[0].part.a, got[0].part.b) == ("", "c ") and any(r.near for r in got) and not all(r.near for r in got)


def test_only_texts_with_a_long_line_are_summed_in_wide_lanes(docs_of):
    """A long text of short lines takes the sums that hold four places each."""
    short = "\n".join(" ".join(f"w{i % 13}{j}" for j in range(20)) for i in range(900))
    found = line_dedup.line_hashes(docs_of([(1, short), (2, "x\n" + "b " * 20_000 + "\ny")]), "doc_id", "text")
    assert len(short) > 2 * line_dedup.LONG_LINE
    wide = found.filter("id = 1").count(), found.filter("id = 2").count()
    assert wide == (900, 3)
    want = {i: brute.majority([brute.xxhash.xxh64_intdigest(w.encode(), 42) for w in line.split()]) for i, line in enumerate(short.split("\n"))}
    assert {r.pos: int(r[1], 16) for r in found.filter("id = 1").select("pos", F.hex("fp")).collect()} == want


def test_pairs_beside_the_least_line_are_found_without_it(spark):
    """All near pairs of a block are met, by its least line or, once that is left out, by each other."""
    rng = np.random.default_rng(7)
    seeds = rng.integers(0, 1 << 63, 12)
    fps = [int(s) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for s in seeds for _ in range(9)]
    shared = line_dedup.shared_blocks(spark.createDataFrame(list(enumerate(fps)), "key bigint, fp bigint"))
    heads = {(r.a, r.b) for r in line_dedup.head_pairs(shared).collect()}
    rest = {(r.a, r.b) for r in line_dedup.cross_pairs(shared.filter("key <> head").withColumn("group", F.col("key"))).collect()}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2}
    assert heads | rest == want and rest < want


def test_only_lines_that_may_link_go_on(spark):
    """Of lines in one block, those that meet no other one in two bits and a like size are not fetched; the pairs of the others stay."""
    rng = np.random.default_rng(9)
    seeds = rng.integers(0, 1 << 63, 8)
    fps = [int(s) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for s in seeds for _ in range(9)]
    lines = [(i, fp, int(rng.choice([50, 55, 90]))) for i, fp in enumerate(fps)]
    shared = line_dedup.shared_blocks(spark.createDataFrame(lines, "key bigint, fp bigint, size int"))
    want = {(i, j) for i, a, m in lines for j, b, n in lines if i < j and (a ^ b).bit_count() <= 2 and abs(m - n) <= int(max(m, n) * 0.2 + 1e-9)}
    left = line_dedup.met(shared).withColumn("group", F.col("key"))
    assert {r.key for r in left.select("key").distinct().collect()} == {x for pair in want for x in pair} < {r.key for r in shared.collect()}
    heads = {(r.a, r.b) for r in line_dedup.head_pairs(left).collect()}
    rest = {(r.a, r.b) for r in line_dedup.cross_pairs(left.filter("key <> head")).collect()}
    assert heads | rest == want


def test_beginnings_of_unlike_lines_do_not_settle_like_ones(spark):
    """Lines of different length that begin apart and end alike are similar, though their beginnings differ by almost all that is allowed."""
    rng = random.Random(13)
    words = [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('klmnrst')}{rng.choice('aeiou')}" for _ in range(150)]
    pairs = [(" ".join(words), " ".join([*[rng.choice(words)[::-1] for _ in range(front)], *words[front + gap:]]))
             for front in (10, 20, 25, 30, 36) for gap in (0, 4, 12, 20, 29)]
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, na string, nb string").select(
        "i", line_dedup._similar("na", "nb", 0.8).alias("near")).orderBy("i").collect()
    want = [brute.distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9) for a, b in pairs]
    assert [r.near for r in got] == want and any(want) and not all(want)
