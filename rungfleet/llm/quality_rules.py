"""Quality rules whose cutoffs carry a guarantee from labelled holdouts.

Each rule rejects a document whose measure exceeds a cutoff. Cutoffs come from
a fixed grid. For every stratum, rule and grid value, the labelled good
documents that pass the base rules are counted, and those that the rule would
reject; an exact binomial test of "the false rejection rate is at least the
rule's share of the allowance" is made at a level divided by the number of all
tests (Bonferroni). The lowest cutoff of the grid whose test rejects is taken;
a stratum with too few labels to prove any cutoff has none, and keeps all that
pass the base rules. With probability 1 - ``delta`` no stratum then loses more
than ``allowance`` of its good documents to the rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, materialize, words

WINDOW = 8
#: The rules' measures and their grids, loose to tight.
GRID = {
    "symbols_per_word": (4.0, 2.0, 1.0, 0.5, 0.25, 0.1),
    "duplicate_line_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.25),
    "repeated_word_share": (0.29, 0.25, 0.2, 0.15),
    "chars_per_word": (14.0, 12.0, 10.0, 9.0, 8.0, 7.0),
}
ALLOWANCE, DELTA = 0.02, 0.05


def repeated_words(ws: Column, n: int = WINDOW) -> Column:
    """Words that lie in an ``n``-word window found twice or more in ``ws``, the
    first of them included. Windows are compared by 64-bit hashes of 64-bit word
    hashes, inside one text only."""
    def covered(starts: Column) -> Column:
        """Words in windows of n words at these sorted starts."""
        step = F.transform(starts, lambda s, i: F.least(F.lit(n), F.coalesce(F.get(starts, i + 1), s + n) - s))
        return F.aggregate(step, F.lit(0), lambda a, b: a + b)

    def same_as_neighbour(windows: Column) -> Column:
        """Starts of windows equal to the one before or behind, in order of hash and start."""
        mark = F.filter(windows, lambda w, i: (F.get(windows, i - 1)["h"] == w["h"]) | (F.get(windows, i + 1)["h"] == w["h"]))
        return F.array_sort(F.transform(mark, lambda w: w["at"]))

    def of_windows(hs: Column) -> Column:
        numbered = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(let(numbered, same_as_neighbour), covered))

    def of_words(hs: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hs) - (n - 1)), lambda i: F.xxhash64(F.slice(hs, i, n)))
        return F.when(F.size(hs) > n, let(windows, of_windows)).otherwise(F.lit(0))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), of_words).cast("long")


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """Counts of each row of ``docs(doc_id, text)``: ``n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words`` and ``n_lines`` (lines with a word),
    ``base_failed``, and the columns ``keep``. Null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    counted = docs.select(
        "doc_id",
        *keep,
        let(words(F.col("text")), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), repeated_words(ws).alias("r"))).alias("w"),
        F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("d"))).alias("l"),
    )
    n = F.col("w.n")
    return counted.select(
        "doc_id",
        *keep,
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.d").alias("n_dup_lines"),
        F.col("w.r").alias("n_repeat_words"),
        F.col("l.n").alias("n_lines"),
        ((n < 20) | (100 * F.col("w.r") > 30 * n)).alias("base_failed"),
    )


def _measure(rule: str) -> Column:
    per = {"symbols_per_word": ("n_symbols", "n_words"), "duplicate_line_share": ("n_dup_lines", "n_lines"), "repeated_word_share": ("n_repeat_words", "n_words"), "chars_per_word": ("word_chars", "n_words")}
    a, b = per[rule]
    return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series after a shift by 8; errors below 1e-9."""
    z = n.cast("double") + 9
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z)
    shift = F.lit(0.0)
    for i in range(1, 9):
        shift = shift + F.log(n.cast("double") + i)
    return series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), for any n, as the incomplete beta function
    I(1 - p; n - k, k + 1) by its continued fraction, which settles in a number
    of steps that grows with the root of n. 1 where k is not below n p, and 1
    where n is 0."""
    a, b, x = (n - k).cast("double"), (k + 1).cast("double"), 1.0 - p
    log_top = log_factorial(n) - log_factorial(n - k - 1) - log_factorial(k) + a * math.log(x) + b * math.log(p)
    first = 1 / (1 - (a + b) * x / (a + 1))
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def half(s: Column, term: Column) -> Column:
        """One partial numerator of the fraction."""
        return let(F.struct((1 + term / s["c"]).alias("c"), (1 / (1 + term * s["d"])).alias("d"), s["h"].alias("h")), lambda t: state(t["c"], t["d"], t["h"] * t["c"] * t["d"]))

    def step(s: Column, m: Column) -> Column:
        return let(half(s, m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))), lambda t: half(t, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))))

    steps = F.sequence(F.lit(1), (60 + 4 * F.sqrt(n.cast("double"))).cast("int"))
    total = F.aggregate(steps, state(F.lit(1.0), first, first), step)["h"]
    return F.when(k < n * p, F.least(F.lit(1.0), F.exp(log_top) * total / a)).otherwise(F.lit(1.0))


def select_cutoffs(good: DataFrame, allowance: float = ALLOWANCE, delta: float = DELTA, grid: dict = GRID) -> DataFrame:
    """``stratum, rule, cutoff, n_good, n_rejected, p_value`` from the measures of
    labelled good documents that pass the base rules. One pass with partial
    aggregation: a stratum comes to one row whatever its share of the labels."""
    share = allowance / len(grid)
    counts = [F.count_if(_measure(rule) > c).alias(f"{rule}@{i}") for rule, cs in grid.items() for i, c in enumerate(cs)]
    per = good.groupBy("stratum").agg(F.count("*").alias("n_good"), *counts)
    tests = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{rule}@{i}").alias("n_rejected")) for rule, cs in grid.items() for i, c in enumerate(cs)])
    per = materialize(per)  # one row a stratum by now
    per = per.withColumn("strata", F.lit(max(1, per.count())))
    n_tests = sum(map(len, grid.values()))
    tried = per.select("stratum", "n_good", "strata", F.explode(tests).alias("t")).select("stratum", "n_good", "strata", "t.*")
    return tried.withColumn("p_value", binomial_tail(F.col("n_rejected"), F.col("n_good"), share)).where(F.col("p_value") <= delta / (n_tests * F.col("strata"))).groupBy("stratum", "rule").agg(
        F.min_by(F.struct("cutoff", "n_good", "n_rejected", "p_value"), "cutoff").alias("best")
    ).select("stratum", "rule", "best.*")


def apply_rules(docs: DataFrame, labels: DataFrame, allowance: float = ALLOWANCE, delta: float = DELTA, grid: dict = GRID) -> DataFrame:
    """The measures of each row of ``docs(doc_id, text, lang)`` and ``kept``.

    ``labels(doc_id, quality)`` is the holdout: 1 marks a good document, and of
    several rows of an id the highest counts. Rows with a null id are never
    labelled. Strata are languages, null being one. Null and empty texts and
    texts under 20 words fail the base rules. Without labels, or with an empty
    table, no rule has a cutoff. Rows are judged one by one, so repeated rows
    agree. Other columns are not read.
    """
    seen = materialize(measures(docs.withColumn("stratum", F.coalesce(F.concat(F.lit("lang "), F.col("lang")), F.lit("none"))), "stratum"))
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    cutoffs = materialize(select_cutoffs(seen.where("not base_failed").join(marked, "doc_id", "left_semi"), allowance, delta, grid))
    wide = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(rule) for rule in grid])
    over = [F.coalesce(_measure(rule) > F.col(rule), F.lit(False)) for rule in grid]
    rejected = over[0]
    for x in over[1:]:
        rejected = rejected | x
    return seen.join(wide, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept")
    )
