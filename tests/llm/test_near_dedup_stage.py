"""The near-dedup stage on near copies and rows without ids, and all stages on columns that could clash."""

import random

from pyspark.sql import functions as F

import brute
import corpus_pipeline
from llm_fixtures import SF, docs_of  # noqa: F401


def stage_rows(spark, docs):
    full = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
    return sorted((tuple(r)[:2] for r in corpus_pipeline.simhash_near_dedup(spark, full, "").collect()), key=repr)


def test_near_copies_equal_brute_force(docs_of, spark):
    rng, rows = random.Random(5), []
    for base in range(30):
        words = [f"w{base}x{i}" for i in range(rng.randrange(20, 900))]
        for _ in range(8):
            copy = list(words)
            for at in rng.sample(range(len(copy)), rng.randrange(0, 3)):
                copy[at] = f"new{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(copy)))
    kept = {d for d, _ in stage_rows(spark, docs_of(rows))}
    assert kept == {c for _, _, c in brute.simhash_groups(rows)} and 30 <= len(kept) < len(rows)


def test_rows_without_id_are_documents_of_their_own(docs_of, spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(400)) for x in "abcd")
    docs = docs_of([(None, a), (None, a), (None, b), (None, c), (4, c), (7, a.upper()), (7, d), (7, d), (None, None), (None, "")])
    got = stage_rows(spark, docs)
    assert [r for r in got if r[1] in (b, c, d)] == [(4, c), (7, d), (None, b)]
    assert sum(1 for r in got if not r[1]) == 1
    assert [r for r in got if r[1] and r[1].lower().startswith("a0 ")] == [(7, a.upper())]


def test_columns_of_any_name_and_type_pass_through(docs_of, spark):
    """Names that the operators use themselves, a map, and no n_chars."""
    texts = [(i, f"Some sentence about number {i} that is long enough to be kept.\nshared line of all these documents here") for i in range(30)]
    names = ["digest", "score", "held_out", "n_lines", "n_dropped", "tokens", "key", "fp", "root", "id", "th", "row", "weight", "copies", "topic", "_row"]
    docs = docs_of([*texts, texts[3], (None, texts[4][1]), (None, None)]).withColumns({
        "lang": F.lit("en"), "source": F.lit("s"), "tags": F.create_map(F.lit("k"), F.col("doc_id").cast("string")),
        **{n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names}})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        replaced = corpus_pipeline.DRAWN if name == "mix_sources" else []
        assert out.columns == [c for c in docs.columns if c not in replaced] + replaced
        for r in out.collect():
            assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for n in names if n not in replaced)
            assert r.tags["k"] == (None if r.doc_id is None else str(r.doc_id))
        assert stage(spark, docs.limit(0), SF).count() == 0
