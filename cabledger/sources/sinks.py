"""State changes as pure functions: old table + delta -> new table.

Each keeps the big table on the streamed side of its join, so a delta that Catalyst or AQE finds small
enough is broadcast and the table itself is not shuffled; a large one is sort-merged.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cabledger.operators.pick import first_per_key, last_per_key

HIT = "_hit"


def _aligned(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, in its order and types; missing ones become NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in like.schema.fields
    ])


def new_rows(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``delta`` whose key ``base`` does not hold yet."""
    keys = list(keys)
    known = base.select(*keys).join(delta.select(*keys), keys, "left_semi")
    return delta.join(known, keys, "left_anti")


def _others(delta: DataFrame, keys: Sequence[str]) -> list[str]:
    """An order when none is given: all other columns, so that the choice does not hang on the partitioning."""
    return [c for c in delta.columns if c not in keys] or list(keys)


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], set_cols: Sequence[str],
           order: Sequence[str] | None = None) -> DataFrame:
    """Insert new keys; on a known key replace only ``set_cols``. Of delta rows of one key the last in ``order`` counts."""
    delta = last_per_key(delta, keys, order or _others(delta, keys))
    updated = update_join(base, delta, keys, {c: F.col(f"_d_{c}") for c in set_cols}, carry=set_cols)
    return updated.unionByName(_aligned(new_rows(base, delta, keys), base))


def insert_ignore(base: DataFrame, delta: DataFrame, keys: Sequence[str],
                  order: Sequence[str] | None = None) -> DataFrame:
    """Insert new keys only; among delta rows of one key the first in ``order`` wins."""
    fresh = first_per_key(new_rows(base, delta, keys), keys, order or _others(delta, keys))
    return base.unionByName(_aligned(fresh, base))


def update_where(base: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    flagged = base.withColumn(HIT, hit)
    return _assign(flagged, base, values)


def update_join(base: DataFrame, other: DataFrame, on: Sequence[str], values: Mapping[str, Column],
                carry: Sequence[str] = ()) -> DataFrame:
    """Update the rows that have a partner in ``other`` (one row per key).

    ``values`` may use the partner's columns named in ``carry`` with the prefix ``_d_``.
    """
    on = list(on)
    partner = other.select(*on, *[F.col(c).alias(f"_d_{c}") for c in carry], F.lit(True).alias(HIT))
    joined = base.join(partner, on, "left").withColumn(HIT, F.coalesce(HIT, F.lit(False)))
    return _assign(joined, base, values)


def _assign(flagged: DataFrame, base: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    return flagged.select(*[
        F.when(F.col(HIT), values[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name)
        if f.name in values else F.col(f.name)
        for f in base.schema.fields
    ])


def ids_of_inserted(parent: DataFrame, children: DataFrame, natural_key: Sequence[str], id_col: str) -> DataFrame:
    """Give child rows the id of the parent row they were sent in with."""
    return children.drop(id_col).join(parent.select(*natural_key, id_col), list(natural_key))
