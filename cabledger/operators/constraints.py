"""Table constraints as queries: row rules, unique keys, links between tables and deletes.

Violations come as one row each: ``table``, ``rule`` and the ``key`` of the offending row as text.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cabledger import schema
from cabledger.functions.text import folded
from cabledger.session import materialize

# Keys compared without regard to case, accents and trailing blanks.
TEXT_KEYS = {"email", "license_plate", "code", "city", "license_num", "phone", "cnic"}


def _key_text(table: str) -> Column:
    return F.col(schema.PRIMARY_KEY[table]).cast("string")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_rules(table: str) -> list[tuple[str, Column]]:
    """(rule name, violated) for every NOT NULL, word list, length and range rule of a table."""
    rules: list[tuple[str, Column]] = []
    optional = schema.NULLABLE.get(table, set())
    rules += [(f"{n}_missing", F.col(n).isNull()) for n in schema.names(table) if n not in optional]
    rules += [(f"{n}_unknown", ~F.col(n).isin(words)) for n, words in schema.DOMAINS.get(table, {}).items()]
    rules += [(f"{n}_too_long", F.length(n) > most) for n, most in schema.LENGTHS.get(table, {}).items()]
    rules += [(name, ~F.expr(rule)) for name, rule in schema.ROW_RULES.get(table, {}).items()]
    return rules


def check_constraints(df: DataFrame, table: str) -> DataFrame:
    """All row rules in one scan, one output row per broken rule."""
    broken = F.filter(F.array(*[F.when(bad, name) for name, bad in row_rules(table)]), lambda r: r.isNotNull())
    return df.select(F.lit(table).alias("table"), F.explode(broken).alias("rule"), _key_text(table).alias("key"))


def check_unique(df: DataFrame, table: str) -> DataFrame:
    """Key values held by more than one row: ``table``, ``rule``, ``key`` and how many ``rows``.

    Counted, not listed, so a value repeated in a third of the table stays one row.
    """
    parts = []
    for keys in [[schema.PRIMARY_KEY[table]], *schema.UNIQUE_KEYS.get(table, [])]:
        present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        shown = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        # Equal spellings are counted first (hashed, combined in the map tasks), then folded together.
        exact = df.filter(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("_shown", shown)
        fold = [folded(F.col(k)) if k in TEXT_KEYS else F.col(k) for k in keys]
        if any(k in TEXT_KEYS for k in keys):
            exact = exact.groupBy(*fold).agg(F.sum("n").alias("n"), F.min("_shown").alias("_shown"))
        parts.append(exact.filter(F.col("n") > 1).select(
            F.lit(table).alias("table"), F.lit("_".join(keys) + "_repeated").alias("rule"),
            F.col("_shown").alias("key"), F.col("n").alias("rows")))
    return _union(parts)


def check_foreign_keys(t: Mapping[str, DataFrame], table: str) -> DataFrame:
    """Rows whose link points at no parent; empty links are fine."""
    parts = []
    for link in (x for x in schema.LINKS if x.child == table):
        parents = t[link.parent].select(F.col(link.parent_key).alias(link.column))
        children = t[table].select(*{link.column, schema.PRIMARY_KEY[table]})
        orphans = children.filter(F.col(link.column).isNotNull()).join(parents, link.column, "left_anti")
        parts.append(orphans.select(F.lit(table).alias("table"), F.lit(f"{link.column}_unknown").alias("rule"),
                                    _key_text(table).alias("key")))
    return _union(parts)


def check_not_self(df: DataFrame, table: str) -> DataFrame:
    """Rows whose two ends are the same: pickup and drop-off, rater and rated, both sides of a complaint."""
    a, b = schema.DISTINCT_PAIRS[table]
    return df.filter(F.col(a) == F.col(b)).select(
        F.lit(table).alias("table"), F.lit(f"{a}_equals_{b}").alias("rule"), _key_text(table).alias("key"))


def propagate_delete(t: Mapping[str, DataFrame], table: str, keys: DataFrame) -> DataFrame:
    """What deleting ``keys`` (one column, the key of ``table``) does to every table.

    One row per affected row and link: ``table``, ``key``, ``column`` and ``action``: ``delete`` for the rows
    themselves and those that go with them, ``set_null`` for links that are emptied, ``blocked`` for rows
    that forbid the delete. Every table that links to one losing rows must be in ``t``; a missing one is an error, not an empty answer.
    """
    gone = _closure(t, table, keys)
    actions = {"set_null": "set_null", "restrict": "blocked"}
    parts = []
    for name, ids in gone.items():
        key = schema.PRIMARY_KEY[name]
        parts.append(ids.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"),
                                F.lit(key).alias("column"), F.lit("delete").alias("action")))
        for link in (x for x in schema.LINKS if x.parent == name and x.on_delete != "cascade"):
            hit = t[link.child].join(ids.select(F.col(key).alias(link.column)), link.column, "left_semi")
            parts.append(hit.select(F.lit(link.child).alias("table"), _key_text(link.child).alias("key"),
                                    F.lit(link.column).alias("column"), F.lit(actions[link.on_delete]).alias("action")))
    return _union(parts)


def _closure(t: Mapping[str, DataFrame], table: str, keys: DataFrame) -> dict[str, DataFrame]:
    """Table -> keys of its rows that go, found along the cascading links by a frontier that holds only keys not met before."""
    losing = [table]
    for name in losing:
        losing += [x.child for x in schema.LINKS if x.parent == name and x.on_delete == "cascade" and x.child not in losing]
    missing = {x.child for x in schema.LINKS if x.parent in losing} | {table}
    if missing := sorted(n for n in missing if n not in t):
        raise KeyError(f"a delete from {table} also concerns {', '.join(missing)}")
    key = schema.PRIMARY_KEY[table]
    frontier = {table: materialize(t[table].select(key).join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_semi"))}
    gone: dict[str, DataFrame] = {}
    while frontier:
        reached: dict[str, DataFrame] = {}
        for name, ids in frontier.items():
            gone[name] = gone[name].unionByName(ids) if name in gone else ids
            for link in (x for x in schema.LINKS if x.parent == name and x.on_delete == "cascade"):
                child = schema.PRIMARY_KEY[link.child]
                hit = t[link.child].join(ids.select(F.col(schema.PRIMARY_KEY[name]).alias(link.column)), link.column, "left_semi").select(child)
                reached[link.child] = reached[link.child].unionByName(hit) if link.child in reached else hit
        frontier = {}
        for name, ids in reached.items():
            fresh = ids.distinct() if name not in gone else ids.distinct().join(gone[name], schema.PRIMARY_KEY[name], "left_anti")
            fresh = materialize(fresh)
            if name not in gone or not fresh.isEmpty():
                frontier[name] = fresh
    return gone
