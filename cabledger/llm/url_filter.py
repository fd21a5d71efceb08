"""URL filter: host and path rules, and a character language-model ratio for what no rule decides.

Two variable-order Markov models, of accepted and of rejected URLs, share their contexts: the longest context of up to
``ORDER`` characters that has been seen decides, and Witten-Bell smoothing passes the rest down to shorter ones. Counts are kept
per gram, so the models are joins of gram tables; a URL's score is the mean log-likelihood difference per character. The
cut is the score that parts a held-out fold of the training URLs best.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cabledger.session import materialize

ORDER = 5
#: Stands before the first character; it is no character of a URL (fixed value).
START = "\x02"
#: Probability of a character before any has been seen.
BASE = 1 / 256
#: One training URL in so many is kept for the calibration.
FOLDS = 5
#: Scores are calibrated in steps of this size, between plus and minus LIMIT.
STEP, LIMIT = 0.01, 20.0
Rule = tuple[str, str, str]


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty for null or without ``://``."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise(F.lit(""))
    whole = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    return (F.translate(whole, string.ascii_uppercase, string.ascii_lowercase),
            F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2))


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule (host and path) and its verdict; null when none fits. Of equally long rules the first wins.

    A rule fits its host and all subdomains when the path starts with the rule's. A few rules become one
    expression; thousands would be a join on the suffixes of the host instead.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(sorted(rules, key=lambda r: -len(r[0] + r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """Each character of each URL with the contexts before it: one row per URL and position, ``gram`` holding up to
    ``order`` characters of context and the character. Further columns stay."""
    text = F.concat(F.lit(START), F.col("url"))
    return urls.withColumn("gram", F.explode(F.transform(
        F.sequence(F.lit(2), F.length(text)), lambda i: F.substr(text, F.greatest(F.lit(1), i - order), F.least(i, F.lit(order + 1))))))


def _model(training: DataFrame, order: int) -> list[DataFrame]:
    """Per context length 0..order: (gram, a, r, ca, cr, ta, tr): counts of the gram, of its context and of the
    different characters after the context, for accepted and rejected URLs."""
    full = (_grams(training, order).groupBy("gram").agg(
        F.sum(F.col("accepted").cast("bigint")).alias("a"), F.sum((~F.col("accepted")).cast("bigint")).alias("r")))
    full = materialize(full)
    levels = []
    for k in range(order + 1):
        # a gram near the start is shorter than the order; it counts at every length up to its own
        counts = (full.filter(F.length("gram") > k).groupBy(F.right("gram", F.lit(k + 1)).alias("gram"))
                  .agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
        context = F.left("gram", F.lit(k))
        around = Window.partitionBy(context)
        levels.append(counts.select(
            "gram", "a", "r", F.sum("a").over(around).alias("ca"), F.sum("r").over(around).alias("cr"),
            F.sum((F.col("a") > 0).cast("int")).over(around).alias("ta"), F.sum((F.col("r") > 0).cast("int")).over(around).alias("tr")))
    return levels


def _log_ratios(training: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """(gram, d): log P(accepted) - log P(rejected) of the last character of every gram in ``wanted.gram``."""
    found = wanted.select("gram").distinct().withColumns({"pa": F.lit(BASE), "pr": F.lit(BASE)})
    for k, level in enumerate(_model(training, order)):
        tail = F.right("gram", F.lit(k + 1))
        contexts = level.groupBy(F.left("gram", F.lit(k)).alias("_x")).agg(*[F.max(c).alias(c) for c in ("ca", "cr", "ta", "tr")])
        counts = level.select(F.col("gram").alias("_g"), "a", "r")
        found = (found.withColumn("_t", F.when(F.length("gram") > k, tail)).withColumn("_c", F.left("_t", F.lit(k)))
                 .join(contexts, F.col("_c") == F.col("_x"), "left").join(counts, F.col("_t") == F.col("_g"), "left"))

        def smoothed(n: str, total: str, kinds: str, below: str) -> Column:
            seen = (F.coalesce(n, F.lit(0)) + F.col(kinds) * F.col(below)) / (F.col(total) + F.col(kinds))
            return F.when(F.col(total) > 0, seen).otherwise(F.col(below))
        found = found.select("gram", smoothed("a", "ca", "ta", "pa").alias("pa"), smoothed("r", "cr", "tr", "pr").alias("pr"))
    return found.select("gram", (F.log("pa") - F.log("pr")).alias("d"))


def _cut(scored: DataFrame) -> DataFrame:
    """One row, ``cut``: the least score of the calibration fold that is accepted, chosen for the best mean of both
    classes' shares put right, midway between two scores; the one nearest to zero among the best. Counts per step, at most 2 * LIMIT / STEP + 1."""
    counts = (scored.groupBy(F.round(F.col("score") / STEP).cast("int").alias("step"))
              .agg(F.sum(F.col("accepted").cast("bigint")).alias("a"), F.sum((~F.col("accepted")).cast("bigint")).alias("r")))
    below = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = F.col("step")
    middle = (step + F.coalesce(F.lag("step").over(Window.orderBy("step")), step - 1)) / 2
    rates = counts.select((middle * STEP).alias("cut"), (
        F.coalesce(F.sum("r").over(below), F.lit(0)) / F.greatest(F.sum("r").over(every), F.lit(1))
        + (F.sum("a").over(every) - F.coalesce(F.sum("a").over(below), F.lit(0))) / F.greatest(F.sum("a").over(every), F.lit(1))
    ).alias("right"))
    return rates.agg(F.coalesce(F.max_by("cut", F.struct(F.round("right", 9), -F.abs("cut"))), F.lit(0.0)).alias("cut"))


def score_urls(urls: DataFrame, training: DataFrame, order: int = ORDER) -> DataFrame:
    """(url, score, cut): mean log-likelihood difference per character of every distinct non-null ``urls.url``.

    ``training`` has url and a boolean ``accepted``. The fold ``xxhash64(url) mod FOLDS = 0`` of it sets the cut and is not learnt from.
    """
    training = training.filter("url is not null and url <> '' and accepted is not null").select("url", "accepted")
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0
    # A set number of partitions, since a few bytes of URLs become many rows of grams.
    tasks = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    urls = urls.select("url").filter("url is not null and url <> ''").repartition(tasks, "url").distinct()
    grams = materialize(_grams(urls, order).groupBy("url", "gram").agg(F.count(F.lit(1)).alias("n")))
    each = materialize(_log_ratios(training.filter(~fold), grams, order))
    limit = F.lit(LIMIT)
    scores = (grams.join(each, "gram").groupBy("url").agg((F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("score"))
              .withColumn("score", F.greatest(-limit, F.least(limit, "score"))))
    scores = materialize(scores)
    labelled = training.filter(fold).groupBy("url").agg(F.max("accepted").alias("accepted"))
    cut = _cut(scores.join(labelled, "url")).first()["cut"]
    return scores.withColumn("cut", F.lit(cut))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, url, host, path, rule, score, verdict) for every row of ``pages``.

    The rule decides where one fits. Elsewhere the models do, trained on the URLs that rules have decided: allow when
    the score reaches the cut. Null and empty URLs have no score and are allowed, as are all when the rules
    decide none. Equal URLs get equal verdicts; repeated rows and null ids are kept. An empty table gives no rows;
    other columns are not read.
    """
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_by_rule": verdict})
    training = rows.filter(F.col("_by_rule").isNotNull()).select("url", (F.col("_by_rule") == "allow").alias("accepted")).distinct()
    scored = score_urls(rows, training)
    by_model = F.when(F.col("score") < F.col("cut"), F.lit("block")).otherwise(F.lit("allow"))
    return (rows.join(scored, "url", "left")
            .select("id", "url", "host", "path", "rule", "score", F.coalesce("_by_rule", by_model).alias("verdict")))
