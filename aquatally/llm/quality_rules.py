"""Quality rules per document, and host verdicts from shrunken failure rates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aquatally.llm.util import add_columns, as_bytes, named, plain, written

SYMBOLS = tuple(bytes([c]) for c in b"#*$%&|<>")
WINDOW = 5
SMALL_HOSTS = 100_000
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(words: list[bytes]) -> int:
    """Words within a 5-word window that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    own = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    size = len(words) + 1
    # names of windows of 2, 4, then 5 words; a pair of names below `size` is one number
    two = np.unique(own[:-1] * size + own[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * size + two[2:], return_inverse=True)[1]
    five, counts = np.unique(four[:n] * size + own[WINDOW - 1 :], return_inverse=True, return_counts=True)[1:]
    starts = np.flatnonzero(counts[five] >= 2)
    if len(starts) == 0:
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(texts: pa.Array) -> Sequence[list[int]]:
    n_words, chars, symbols, dup_lines, repeats, n_lines = [], [], [], [], [], []
    for raw in as_bytes(texts):
        raw = raw or b""
        words = raw.split()
        n_words.append(len(words))
        solid = b"".join(words)
        chars.append(len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace")))
        symbols.append(sum(map(raw.count, SYMBOLS)))
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        n_lines.append(len(lines))
        dup_lines.append(len(lines) - len(set(lines)))
        repeats.append(repeated_words(words))
    return n_words, chars, symbols, dup_lines, repeats, n_lines


def rules() -> dict[str, Column]:
    """The rules by name, each true where a document fails it and goes for that alone."""
    return {
        "short": F.col("n_words") < 10,
        "repetitive": F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"),
    }


def doubts() -> dict[str, Column]:
    """Further rules: a document that breaks one goes only if that is the habit of its host.

    More than one symbol to ten words, more than three lines in ten repeated, or words of less than three or
    more than ten characters on average.
    """
    n = F.col("n_words")
    return {
        "symbols": F.lit(10) * F.col("n_symbols") > n,
        "same_lines": F.lit(10) * F.col("n_dup_lines") > F.lit(3) * F.col("n_lines"),
        "odd_words": (F.col("word_chars") < F.lit(3) * n) | (F.col("word_chars") > F.lit(10) * n),
    }


def host_verdicts(
    failures: DataFrame, worst_rate: float = 0.9, min_hosts: int = 2, least_weight: float = 20.0, habit: float = 0.5
) -> DataFrame:
    """(host, rule, n_docs, n_failed, shrunk_rate, host_failed, host_habit) from (host, rule, n_docs, n_failed).

    For each rule the hosts' rates get a beta prior, fitted to their mean and variance weighted by
    documents; a host's rate is then (failed + alpha) / (documents + alpha + beta), so that one
    with few documents stays near the mean of all.  Sampling alone spreads rates by
    m (1 - m) / n; only the spread beyond that is the hosts' own.  A host fails if the
    shrunken rate reaches ``worst_rate``, and breaking the rule is its habit at ``habit``
    and twice the mean of all hosts: what most of a corpus does is no fault of one.  If hosts differ no more than chance has it, or there are fewer than
    ``min_hosts``, the prior is the mean with the weight of an average host; it weighs as much as
    ``least_weight`` documents at least, so that no host fails on a handful.
    """
    rate = F.col("n_failed") / F.col("n_docs")
    prior = failures.groupBy(F.col("rule").alias("__rule")).agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("n_docs").alias("docs"),
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        (F.sum(F.col("n_failed") * rate) / F.sum("n_docs")).alias("square"),
    )
    spread = F.col("mean") * (1 - F.col("mean"))
    chance = spread * F.col("hosts") / F.col("docs")
    own = F.col("square") - F.col("mean") * F.col("mean") - chance
    weight = (
        F.when((own <= 0) | (F.col("hosts") < min_hosts), F.col("docs") / F.col("hosts"))
        .when(spread <= own, F.lit(0.0))
        .otherwise(spread / own - 1)
    )
    prior = prior.withColumn("weight", F.greatest(weight, F.lit(least_weight))).select("__rule", "mean", "weight")
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    return (
        failures.join(prior, F.col("rule") == F.col("__rule"))
        .withColumn("shrunk_rate", shrunk)
        .withColumn("host_failed", F.col("shrunk_rate") >= worst_rate)
        .withColumn("host_habit", F.col("shrunk_rate") >= F.greatest(F.lit(habit), 2 * F.col("mean")))
        .drop("__rule", "mean", "weight")
    )


def apply_rules(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    worst_rate: float = 0.9,
    habit: float = 0.5,
    with_text: bool = True,
) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``host_failed``, ``habit_failed`` and ``kept``.

    A document fails by itself if it breaks one of ``rules``.  It fails by its host if the shrunken failure rate there
    of one of these reaches ``worst_rate``, and by its host's habit if it raises one of ``doubts`` that half
    of the host (``habit``) raises too, and twice as often as hosts do: a table full of symbols goes from a
    host of such tables, but not from a host of prose.  Null text counts as empty, which is too short.  Documents without a host are judged by
    themselves alone.  Repeated rows count one by one.  An empty table stays empty.  Columns that
    clash with new ones are replaced, others pass whatever their names.

    Every text is measured once: the rows with their measures are one table, without the texts if
    ``with_text`` is false, and verdicts join that.
    """
    docs, names = plain(docs)
    text_col, host_col = names[text_col], names[host_col]
    if not with_text:
        names = {c: n for c, n in names.items() if n != text_col}
    broken, doubted = rules(), doubts()
    flags = {**broken, **doubted}
    measured = add_columns(docs, [text_col], MEASURES, measure, () if with_text else [text_col])
    measured = written(measured, "rules-measured")
    failures = (
        measured.where(F.col(host_col).isNotNull())
        .groupBy(F.col(host_col).alias("host"))
        .agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(flag).alias(name) for name, flag in flags.items()])
        .unpivot(["host", "n_docs"], list(flags), "rule", "n_failed")
    )
    verdicts = written(host_verdicts(failures, worst_rate, habit=habit), "host-verdicts")
    bad = verdicts.where("host_failed or host_habit").groupBy("host").agg(
        F.bool_or(F.col("host_failed") & F.col("rule").isin(*broken)).alias("all_of_it"),
        F.collect_list(F.when(F.col("host_habit"), F.col("rule"))).alias("habits"),
    )
    if bad.count() <= SMALL_HOSTS:  # proven small: then no text moves
        bad = F.broadcast(bad)
    habits = [F.array_contains("habits", name) & flag for name, flag in doubted.items()]
    out = (
        measured.withColumn("base_failed", reduce(or_, broken.values()))
        .join(bad, F.col(host_col) == F.col("host"), "left")
        .withColumn("host_failed", F.coalesce("all_of_it", F.lit(False)))
        .withColumn("habit_failed", F.coalesce(reduce(or_, habits), F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed") & ~F.col("habit_failed"))
    )
    new = [m.split()[0] for m in MEASURES.split(", ")]
    return named(out, names, [*new, "base_failed", "host_failed", "habit_failed", "kept"])


def passing(docs: DataFrame, text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    docs, names = plain(docs)  # so that none clashes with a measure
    ruled = apply_rules(docs, names[text_col], names[host_col], **options)
    return named(ruled.where("kept"), names)
