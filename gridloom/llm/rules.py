"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once per document.  The ledger holds the measurements
and one failure bit per rule; a policy is a versioned mask over those bits, so
changing a policy never reads the text again, and ablations are aggregations
over the few distinct masks.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.plans.durable import durable
from gridloom.plans.session import bounded_batches

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL predicate over the measurements; bit is the position."""

    bit: int
    name: str
    fails: str


#: Integer arithmetic only, so that every engine decides alike.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "many_symbols", "100 * n_symbols > 30 * n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
)

#: Policies are never edited; a change is a new version.
POLICIES = {"base-v1": ("few_words", "repeated_words"), "default-v1": tuple(r.name for r in RULES)}


def measure_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The six measurements of one whole text; null counts as empty."""
    if not text:
        return (0, 0, 0, 0, 0, 0)
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        times = Counter(windows)
        if len(times) < len(windows):
            twice = np.fromiter((times[x] > 1 for x in windows), dtype=bool, count=n - 2)
            hit = np.zeros(n, dtype=bool)
            for k in range(3):
                hit[k : n - 2 + k] |= twice
            repeat = int(hit.sum())
    return (n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeat)


@F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measures(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure_text(x) for x in text], columns=list(MEASURES), dtype="int64")


def policy_mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return reduce(lambda a, b: a | b, (bits[n] for n in names), 0)


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in rules)).cast("long")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the measurements and ``failures`` (one bit per failed rule).

    Written once and read again, so that policies and ablations never come
    back to the text.  One row per input row, no shuffle.  Null and empty texts measure zero and
    so fail ``few_words``; repeated rows stay; other columns aren't read.
    """
    measured = bounded_batches(docs).select(F.col(key), _measures(F.col(text)).alias("m")).select(key, "m.*")
    return durable(measured.withColumn("failures", failure_bits(rules)), "rules-ledger")


def apply_policy(rows: DataFrame, policy: str = "default-v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``kept``: no failed rule is in the policy's mask."""
    return rows.withColumn("kept", F.col("failures").bitwiseAND(F.lit(policy_mask(POLICIES[policy], rules))) == 0)


def ablation(rows: DataFrame, policy: str = "default-v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: failures, sole failures, rows kept with it and without it.

    The ledger is first reduced to a count per distinct mask (at most two to
    the number of rules), combined map side, so the text is never read again.
    """
    mask = policy_mask(POLICIES[policy], rules)
    counts = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    chosen = [r for r in rules if r.name in POLICIES[policy]]
    spread = counts.select(
        "bits", "n", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in chosen])).alias("r")
    ).select("bits", "n", "r.*")
    when = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return spread.groupBy("rule").agg(
        when(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        when(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        when(F.col("bits") == 0).alias("n_kept_with"),
        when((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"),
    )
