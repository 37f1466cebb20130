"""Secret scans: fixed patterns, and sliding-window entropy of candidate strings.

Everything is column expressions, one row at a time.  Spans come from cutting a
text at a pattern: the lengths of the pieces and of the matches, summed up, are
the places of the matches in code points.

A candidate is a run of characters that keys and digests are written in.  A
window of fixed width slides over it with a count for each character; when one
enters or leaves, its count changes by one and the sum of c * log2(c) over the
counts by a table entry, and Shannon's entropy is log2(width) minus that sum over
the width.  A candidate whose best window reaches the threshold of its character
class is a span.  An allow-list suppresses candidates that are identifiers or
marked as examples as a whole, and of others the windows that touch a filler.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.text import computed_once

#: Kind, pattern, group whose length is checked, least length.
BASE = (
    ("assign", "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
               "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?"
               "([A-Za-z0-9+/_.=-]+)", 1, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least bits of entropy in the best window by character class: what nine of ten random
#: strings of 32 reach.  Letters of one case do not differ from words by entropy; their bar
#: lies above what sentences reach (README has the shares found).
THRESHOLDS = {"digits": 2.6, "hex": 3.0, "cased": 3.85, "letters": 4.2, "mixed": 3.6}
#: Letters are of the class ``cased`` from this share of changes of case on: random ones
#: change in half of their places, names made of words in less than a third.
CHANGES = 0.35
#: Strings that look random and are no secrets.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]",
)
#: Fillers: windows that touch one do not count.
FILLER = "(?:xxxx|XXXX|0000|abcdefghijklmnop|ABCDEFGHIJKLMNOP|0123456789)"
SCALE = 1 << 20


def gain_table(window: int = WINDOW) -> list[int]:
    """c * log2(c) for c = 0..window, as scaled integers."""
    return [round(c * math.log2(c) * SCALE) if c else 0 for c in range(window + 1)]


def most_gain(bits: float, window: int = WINDOW) -> int:
    """The sum up to which a window holds ``bits`` of entropy or more."""
    return math.floor(window * (math.log2(window) - bits) * SCALE)


def running_sums(steps: Column) -> Column:
    """Inclusive running sums of an array of longs; in blocks of about the square
    root of its length, so that appending stays cheap for very long arrays."""
    n = F.size(steps)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
    blocks = F.when(n > 0, F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1)).otherwise(
        F.array().cast("array<int>"))

    def run(xs: Column, start: Column) -> Column:
        return F.slice(F.aggregate(xs, F.array(start), lambda acc, x: F.concat(
            acc, F.array(F.element_at(acc, -1) + x))), F.lit(2), F.greatest(F.size(xs), F.lit(1)))

    totals = F.transform(blocks, lambda b: F.aggregate(
        F.slice(steps, b * width + 1, width), F.lit(0).cast("long"), lambda acc, x: acc + x))
    before = F.concat(F.array(F.lit(0).cast("long")), run(totals, F.lit(0).cast("long")))
    return F.flatten(F.transform(blocks, lambda b: run(
        F.slice(steps, b * width + 1, width), F.element_at(before, b + 1))))


def _with_spans(df: DataFrame, text: str, out: str, kind: str, rank: int, pattern: str) -> DataFrame:
    """Adds array ``out`` of struct(start, rank, end, kind, value, checked)."""
    found = F.col(text).rlike(pattern)
    none = F.array().cast("array<string>")
    df = df.select("*", F.when(found, F.split(text, pattern, -1)).otherwise(none).alias("_p"),
                   F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias("_m"))
    df = df.select("*", F.zip_with(F.slice("_p", 1, F.greatest(F.size("_m"), F.lit(1))), "_m", lambda p, m: (
        F.length(F.coalesce(p, F.lit(""))) + F.length(F.coalesce(m, F.lit("")))).cast("long")).alias("_d"))
    df = df.select("*", running_sums(F.col("_d")).alias("_e"))
    spans = F.zip_with("_m", "_e", lambda m, e: F.struct(
        (e - F.length(m)).alias("start"), F.lit(rank).alias("rank"), e.alias("end"),
        F.lit(kind).alias("kind"), m.alias("value")))
    return df.select("*", spans.alias(out)).drop("_p", "_m", "_d", "_e")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def best_window(value: Column, window: int = WINDOW) -> Column:
    """The least sum of c * log2(c) over all windows of a string of ASCII
    characters that is ``window`` long or longer, by incremental counts."""
    table = F.array(*map(F.lit, gain_table(window)))

    def gain(count: Column) -> Column:  # what the sum grows by from count to count + 1
        return F.element_at(table, count + 2) - F.element_at(table, count + 1)

    def changed(counts: Column, code: Column, by: int) -> Column:
        return F.concat(F.slice(counts, F.lit(1), code - 1), F.array(F.element_at(counts, code) + by),
                        F.slice(counts, code + 1, 128 - code))

    def scan(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            enters, leaves, full = F.element_at(codes, i), F.element_at(codes, i - window + 1), i >= window
            total = acc["sum"] + gain(F.element_at(acc["counts"], enters))

            def after(counts: Column) -> Column:
                best = F.when(full, F.least(acc["best"], total)).otherwise(acc["best"])
                gone = F.when(full, gain(F.element_at(counts, leaves) - 1)).otherwise(F.lit(0))
                left = F.when(full, changed(counts, leaves, -1)).otherwise(counts)
                return F.struct((total - gone).alias("sum"), best.alias("best"), left.alias("counts"))

            return _let(changed(acc["counts"], enters, 1), after)

        start = F.struct(F.lit(0).alias("sum"), F.lit(2**31 - 1).alias("best"),
                         F.array_repeat(F.lit(0), 128).alias("counts"))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step, lambda acc: acc["best"])

    # A code is the place of a character's count, from 1 on.
    return _let(F.transform(F.split(value, ""), lambda c: F.ascii(c) + 1), scan)


def char_class(value: Column) -> Column:
    changes = F.regexp_count(value, F.lit("[a-z][A-Z]")) + F.regexp_count(value, F.lit("[A-Z][a-z]"))
    return (F.when(value.rlike("^[0-9]+$"), "digits").when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
            .when(value.rlike("^[A-Za-z]+$") & (changes >= CHANGES * (F.length(value) - 1)), "cased")
            .when(~value.rlike("[0-9]"), "letters").otherwise("mixed"))


def windowed_parts(value: Column, window: int = WINDOW) -> Column:
    """The parts of a string between fillers that hold a window."""
    return F.filter(F.split(value, FILLER, -1), lambda p: F.length(p) >= window)


def _long_enough(pattern: str, group: int, least: int):
    if group:
        return lambda s: F.length(F.regexp_extract(s["value"], pattern, group)) >= least
    return lambda s: F.length(s["value"]) >= least


def secret_spans(docs: DataFrame, carry: list[Column], text: Column) -> DataFrame:
    """``carry`` columns and ``spans``: an array of struct(start, end, kind,
    value) by start, then kind in the order assign, access, hex, entropy.

    Starts and ends count code points, ends are exclusive.  Patterns match
    leftmost without overlap, each kind for itself; an entropy span inside a span
    of a pattern is left out.  Null text counts as empty; repeated rows give a row
    each; nothing is shuffled.
    """
    df = docs.select(F.struct(*carry).alias("_row"), F.coalesce(text, F.lit("")).alias("_t"))
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        df = _with_spans(df, "_t", f"_{kind}", kind, rank, pattern)
        df = df.withColumn(f"_{kind}", F.filter(f"_{kind}", _long_enough(pattern, group, least)))
    df = _with_spans(df, "_t", "_candidates", "entropy", len(BASE), CANDIDATE)
    df = df.withColumn("_base", F.concat(*[F.col(f"_{b[0]}") for b in BASE]))
    limit = {k: most_gain(v) for k, v in THRESHOLDS.items()}

    def secret(s: Column) -> Column:
        v = s["value"]
        allowed = F.lit(False)
        for p in ALLOWED:
            allowed = allowed | v.rlike(p)
        known = F.exists("_base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
        cls = char_class(v)
        top = F.lit(limit["mixed"])
        for k, x in limit.items():
            top = F.when(cls == k, F.lit(x)).otherwise(top)
        return ~known & ~allowed & F.exists(windowed_parts(v), lambda p: best_window(p) <= top)

    df = df.withColumn("_entropy", F.filter("_candidates", secret))
    spans = F.transform(F.array_sort(F.concat("_base", "_entropy")), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return df.select("_row", computed_once(spans).alias("spans")).select("_row.*", "spans")


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
