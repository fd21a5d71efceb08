"""One effect per delivery: forms that arrive again, in the same run or a later one, are dropped.

A form is known by its id; a form without an id by its whole content. Of forms that share an id the first in time
counts, ties going to the least row, so the choice hangs on the content alone. Jobs keep ``FORM``, which is unique
among the forms of a run, and pick winners by it, never by the id that came with the form.

The ledger of a job (``form``, ``subject``) holds the forms it has dealt with, refused ones included, and what the
accepted ones were about. A job that is handed the ledger of its earlier runs leaves those forms alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

FORM = "_form"
LEDGER = "form STRING, subject STRING"


def form_key(df: DataFrame, id_cols: Sequence[str]) -> Column:
    """The ids as text, or a digest of the whole row where one is missing."""
    ids = F.concat(F.lit("#"), F.concat_ws("|", *(F.col(i).cast("string") for i in id_cols)))
    missing = F.greatest(*(F.col(i).isNull() for i in id_cols), F.lit(False))
    return F.when(missing, F.concat(F.lit("~"), F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256))).otherwise(ids)


def once(forms: DataFrame, id_cols: str | Sequence[str], order: Sequence[str], applied: DataFrame | None = None) -> DataFrame:
    """Each form once, with its key in ``FORM``, without those in the ledger ``applied``.

    The pick is an aggregate, so a form sent a million times costs one row per map task.
    """
    id_cols = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    columns = forms.columns
    row = F.struct(*columns)
    picked = forms.groupBy(form_key(forms, id_cols).alias(FORM)).agg(
        F.min_by(row, F.struct(*(F.col(o) for o in order), row)).alias("_row"))
    if applied is not None:
        seen = applied.select(F.col("form").alias(FORM)).join(picked.select(FORM), FORM, "left_semi").distinct()
        picked = picked.join(seen, FORM, "left_anti")
    return picked.select("_row.*", FORM).select(*columns, FORM)


def ledger(forms: DataFrame, applied: DataFrame | None = None, subjects: DataFrame | None = None, subject: str | None = None) -> DataFrame:
    """The ledger after a run over ``forms``; ``subjects`` holds ``FORM`` and ``subject`` of the forms that took effect."""
    new = forms.select(FORM)
    if subjects is None:
        found = new.withColumn("subject", F.lit(None).cast("string"))
    else:
        found = new.join(subjects.select(FORM, F.col(subject).cast("string").alias("subject")), FORM, "left")
    found = found.select(F.col(FORM).alias("form"), "subject")
    return found if applied is None else applied.select("form", "subject").unionByName(found)
