"""Secret scan: three base patterns, and a battery of randomness tests for anything else that looks like a key.

A candidate is a long run of key characters. Its encoding is the narrowest alphabet that holds it. Three tests ask
whether it could be uniformly random over that alphabet: chi-squared over the alphabet, runs above and below the
middle, and serial correlation of neighbours. What passes is weighed against ordinary text: the p-value of a
chi-squared that low if characters came from the mix of ordinary words, whose mean grows with the length. Among all
candidates of the corpus with a similar length, the Benjamini-Hochberg rule then bounds the share of false finds,
so short tokens, of which there are many and which prove little, need more evidence.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from cabledger.llm.text_keys import let
from cabledger.session import materialize

# Fixed patterns and their least lengths (of group 2 for assign, else of the match).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: A run that is too short hides no longer one, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
_LOWER, _UPPER, _DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
#: Alphabets from narrow to wide; the first that holds the whole token is its encoding.
ALPHABETS = {"dec": _DIGITS, "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "lower": _LOWER, "upper": _UPPER,
             "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER, "base62": _DIGITS + _UPPER + _LOWER,
             "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_"}
#: Digits alone are telephone numbers and counters: they are tested by no key format.
KEYS = [k for k in ALPHABETS if k != "dec"]
#: Excess of the sum of squared character shares over the uniform one, times the alphabet size, in ordinary words:
#: letters by common frequency, upper case and digits rare. Rounded, fixed.
ORDINARY = {"hex": 1.2, "HEX": 1.2, "lower": 0.7, "upper": 0.7, "base32": 1.0, "base36": 1.0, "base62": 2.0,
            "base64": 2.1, "base64url": 2.1}
PASS, FALSE_SHARE = 0.001, 0.01
#: Evidence is counted in bins of 0.05 in -log10(p), at most this many, per doubling of the length.
BINS, PER_DECADE = 400, 20
#: Spans in a chunk.
CHUNK = 128


def _chunks(values: Column) -> Column:
    """``values`` cut into arrays of ``CHUNK``, so that what grows by concatenation stays short."""
    last = F.greatest(F.size(values) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.floor(last / CHUNK).cast("int")), lambda i: F.slice(values, i * CHUNK + 1, F.lit(CHUNK)))


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, keep: bool = False) -> Column:
    """Array of (start, kind, end) of the matches whose ``group`` has ``least`` characters, in code points; with ``keep`` also (token).

    The pieces between matches give the positions, summed up chunk by chunk. Texts without a match are scanned once.
    """
    kinds = "start:int,kind:int,end:int" + (",token:string" if keep else "")
    empty = F.array().cast(f"array<struct<{kinds}>>")

    def span(at: Column, m: Column) -> Column:
        fields = [(at + m["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + m["gap"] + m["len"]).alias("end")]
        return F.struct(*fields, *([m["token"].alias("token")] if keep else []))

    def within(chunk: Column, at: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            out = F.when(m["part"] >= least, F.concat(acc["out"], F.array(span(acc["at"], m)))).otherwise(acc["out"])
            return F.struct((acc["at"] + m["gap"] + m["len"]).alias("at"), out.alias("out"))
        return F.aggregate(chunk, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def placed(chunks: Column) -> Column:
        long = F.transform(chunks, lambda chunk: F.aggregate(chunk, F.lit(0), lambda acc, m: acc + m["gap"] + m["len"]))
        starts = F.aggregate(long, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return let(starts, lambda at: F.flatten(F.zip_with(chunks, F.slice(at, 1, F.size(at) - 1), within)))

    def place(pieces: Column) -> Column:
        matches = F.zip_with(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
            lambda m, g: F.struct(F.length(m).alias("len"), F.length(g).alias("part"), *([m.alias("token")] if keep else [])))
        steps = F.zip_with(matches, F.slice(pieces, 1, F.size(pieces) - 1), lambda m, p: F.struct(
            F.length(p).alias("gap"), m["len"].alias("len"), m["part"].alias("part"), *([m["token"].alias("token")] if keep else [])))
        return F.when(F.size(pieces) > 1, let(let(steps, _chunks), placed)).otherwise(empty)
    return let(F.split(text, pattern, -1), place)


def _normal_below(z: Column) -> Column:
    """P(Z < z) of the standard normal, by the rational approximation of Abramowitz and Stegun 26.2.17."""
    a = F.abs(z)
    t = 1 / (1 + a * 0.2316419)
    tail = (0.3989422804014327 * F.exp(-a * a / 2) * t
            * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def _battery(token: Column, encoding: Column) -> Column:
    """(passes, doubt): whether ``token`` could be random over its alphabet, and its p-value as ordinary text."""
    alphabet, k = encoding["letters"], encoding["k"]
    bare = F.rtrim(token, F.lit("="))
    n = F.length(bare).cast("double")
    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda acc, c: F.when(F.length(c) == 0, acc).otherwise(
        acc + F.pow((n - F.length(F.replace(bare, c, F.lit("")))), F.lit(2))))
    halves = F.call_function("translate", bare, alphabet, encoding["halves"])
    middle = (k - 1) / 2
    values = F.transform(F.filter(F.split(bare, ""), lambda c: F.length(c) > 0), lambda c: F.instr(alphabet, c) - 1 - middle)
    product = let(values, lambda v: F.aggregate(
        F.transform(v, lambda x, i: x * F.coalesce(F.get(v, i + 1), F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x))

    def judge(x2: Column, h: Column) -> Column:
        ones = n - F.length(F.replace(h, F.lit("1"), F.lit("")))
        turns = (2 * n - F.length(F.replace(h, F.lit("01"), F.lit(""))) - F.length(F.replace(h, F.lit("10"), F.lit("")))) / 2
        both = 2 * ones * (n - ones)
        spread = both * (both - n) / (n * n * (n - 1))
        runs = F.when(spread > 0, (turns + 1 - (both / n + 1)) / F.sqrt(spread)).otherwise(F.lit(99.0))
        part = F.lit(2.0) / (9 * (k - 1))
        uniform = (F.cbrt(x2 / (k - 1)) - (1 - part)) / F.sqrt(part)
        serial = product / ((n - 1) * ((k * k - 1) / 12)) * F.sqrt(n - 1)
        worst = F.least(_normal_below(-uniform), 2 * _normal_below(-F.abs(runs)), 2 * _normal_below(-F.abs(serial)))
        beyond = n * encoding["ordinary"]
        ordinary = (x2 - (k - 1 + beyond)) / F.sqrt(2 * (k - 1) + 4 * beyond)
        return F.struct((worst * 3 > PASS).alias("passes"), _normal_below(ordinary).alias("doubt"))
    return let(squares * k / n - n, lambda x2: let(halves, lambda h: judge(x2, h)))


def _encoding(token: Column) -> Column:
    """(letters, halves, k, ordinary) of the first alphabet that holds the token; null for digits alone and for none."""
    found = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(KEYS))):
        letters = ALPHABETS[name].replace("-", "")
        dash = "-" if "-" in ALPHABETS[name] else ""
        found = F.when(token.rlike(f"^[{letters}{dash}]+=*$"), F.lit(i)).otherwise(found)
    found = F.when(token.rlike("^[0-9]+=*$"), F.lit(None)).otherwise(found)
    each = F.array(*[F.struct(
        F.lit(ALPHABETS[n]).alias("letters"), F.lit("0" * (len(ALPHABETS[n]) // 2) + "1" * (len(ALPHABETS[n]) - len(ALPHABETS[n]) // 2)).alias("halves"),
        F.lit(float(len(ALPHABETS[n]))).alias("k"), F.lit(ORDINARY[n]).alias("ordinary")) for n in KEYS])
    return F.get(each, found)


def _tested(token: Column) -> Column:
    return let(_encoding(token), lambda e: F.when(e.isNotNull(), _battery(token, e)))


def _graded(span: Column) -> Column:
    """(start, end, cls, bin, passes) of a candidate span."""
    return let(_tested(span["token"]), lambda t: F.struct(
        span["start"].alias("start"), span["end"].alias("end"),
        F.floor(F.log2((span["end"] - span["start"]).cast("double"))).cast("int").alias("cls"),
        F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(t["doubt"], F.lit(1e-30))) * PER_DECADE)).cast("int").alias("bin"),
        t["passes"].alias("passes")))


def _thresholds(graded: DataFrame) -> DataFrame:
    """(cls, least_bin): the Benjamini-Hochberg cut per length class, from counts per bin; at most 31 classes."""
    counts = (graded.select(F.explode("candidates").alias("c")).filter("c.bin is not null")
              .groupBy(F.col("c.cls").alias("cls"), F.col("c.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    stronger = Window.partitionBy("cls").orderBy(F.desc("bin"))
    ranked = counts.select("cls", "bin", F.sum("n").over(stronger).alias("rank"), F.sum("n").over(Window.partitionBy("cls")).alias("m"))
    worst = F.pow(F.lit(10.0), -F.col("bin") / PER_DECADE)
    return ranked.filter(worst <= FALSE_SHARE * F.col("rank") / F.col("m")).groupBy("cls").agg(F.min("bin").alias("least_bin"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) for every row of ``docs``: arrays of (start, kind, end), kinds numbered as in ``KINDS``.

    ``base`` are the matches of the three patterns, by start, then kind. ``spans`` has them all and the random-looking
    candidates that overlap none of them. Null and empty texts have none. Positions are code points of the whole
    text, ends exclusive. Repeated rows and null ids are scanned each by itself, and count each as a candidate in the
    false-discovery control. An empty table gives no rows; other columns are not read.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.select(
        "id", F.array_sort(F.concat(_spans(text, ASSIGN, 0, 2, ASSIGN_LEAST), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
        .alias("base"), _spans(text, CANDIDATE, 3, keep=True).alias("_seen"))
    graded = materialize(found.select("id", "base", F.transform("_seen", _graded).alias("candidates")))
    cuts = _thresholds(graded).collect()  # at most 31 classes

    def least(cls: Column) -> Column:
        return F.coalesce(*[F.when(cls == r["cls"], F.lit(r["least_bin"])) for r in cuts], F.lit(BINS + 1))

    def meets(span: Column, other: Column) -> Column:
        return (other["start"] < span["end"]) & (span["start"] < other["end"])

    # The base spans in chunks with what each covers, so that most are passed over at once.
    covered = F.transform(_chunks(F.col("base")), lambda part: F.struct(
        F.get(part, F.lit(0))["start"].alias("start"), F.array_max(F.transform(part, lambda b: b["end"])).alias("end"), part.alias("part")))
    strong = F.filter("candidates", lambda c: c["passes"] & (c["bin"] >= least(c["cls"])))
    kept = let(covered, lambda parts: F.filter(strong, lambda c: ~F.exists(parts, lambda p: F.coalesce(meets(c, p), F.lit(False)) & F.exists(
        p["part"], lambda b: meets(c, b)))))
    more = F.transform(kept, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return graded.select("id", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
