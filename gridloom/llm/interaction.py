"""How filters interact: what each removes in every order, and its fair share.

Each document is reduced once to the mask of filters that it fails, and the
table to counts by part and mask (at most two to the number of filters).  The
removal polynomial of a part, the multilinear extension

    f(x) = sum over masks of n(mask) * (1 - prod over i in mask of (1 - x_i)),

holds the rest: its values at corners are what a prefix of filters removes, and
the integral of its partial derivative by x_i along the diagonal is the Shapley
value of filter i.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.durable import durable

SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Filter:
    """``fails`` is a SQL predicate over the measurements of a text; none: the text also has a smaller id."""

    name: str
    fails: str | None


FILTERS = (
    Filter("A", "n_words < 100"),
    Filter("B", "100 * n_distinct < 80 * n_words"),
    Filter("C", "100 * n_upper > 10 * n_chars"),
    Filter("D", "has_symbol"),
    Filter("E", None),
)


def _measured(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    read = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    words = read.withColumn("w", F.array_remove(F.split("t", SPACE), ""))
    return words.select(
        "doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"),
        F.regexp_count("t", F.lit("[A-Z]")).alias("n_upper"), F.char_length("t").alias("n_chars"), F.col("t").rlike("[#$%&*|]").alias("has_symbol"),
    )


def mask_counts(docs: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] = FILTERS, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the filters they fail, and those labelled good and toxic among them.

    Null texts are empty and null parts the empty string.  A repeat is a row
    whose text stands in a row of smaller id, whatever its part; rows without an
    id repeat nothing and are labelled by nothing.  A document is good or toxic
    if any row of ``labels`` with its id says so.  Texts meet only as digests,
    and rows are added up by id and by digest first, so that a crowd of copies
    is one row a task.
    """
    bits = [F.when(F.expr(f.fails), F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(filters) if f.fails]
    own = sum(bits[1:], bits[0]) if bits else F.lit(0)
    repeats = sum(1 << k for k, f in enumerate(filters) if f.fails is None)
    rows = durable(_measured(docs, key, text, part).select("doc_id", "part", "digest", own.alias("own")).groupBy("doc_id", "part", "digest", "own").agg(F.count("*").alias("n")), "audit-texts")
    told = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(o) for c, o in (("quality", "is_good"), ("toxic", "is_toxic"))])
    no = F.lit(False)
    labelled = (
        rows.filter("doc_id IS NOT NULL").join(told, "doc_id", "left").withColumns({c: F.coalesce(c, no) for c in ("is_good", "is_toxic")})
        .unionByName(rows.filter("doc_id IS NULL").withColumns({"is_good": no, "is_toxic": no}))
    )
    kinds = labelled.groupBy("digest", "part", "own", "is_good", "is_toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
    )
    # Kinds of one digest differ in part and labels alone, so they are few.
    first = kinds.groupBy("digest").agg(F.min("least.doc_id").alias("first_id"))
    fresh = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first_id"), F.col("least.n")).otherwise(0)
    split = kinds.join(first, "digest").select(
        "part", "is_good", "is_toxic",
        F.inline(F.array(F.struct(F.col("own").alias("mask"), fresh.alias("n")), F.struct(F.col("own").bitwiseOR(F.lit(repeats)).alias("mask"), (F.col("n") - fresh).alias("n")))),
    )
    tally = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), tally("is_good").alias("good"), tally("is_toxic").alias("toxic"))


def _polynomial(counts: Column, field: str, corners: int) -> Column:
    """Coefficients of the removal polynomial by the bits of their monomial: inclusion and exclusion over the masks that hold it."""
    holding = lambda s: F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + F.when(x["mask"].bitwiseAND(s) == s, x[field]).otherwise(0))
    return F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), lambda s: F.when(s == 0, 0).otherwise(F.when(F.bit_count(s) % 2 == 1, holding(s)).otherwise(-holding(s))).cast("long"))


def _corners(poly: str, corners: int) -> Column:
    """The polynomial at every corner: the sum of the coefficients whose monomial is all ones there."""
    every = F.sequence(F.lit(0), F.lit(corners - 1))
    return F.transform(every, lambda p: F.aggregate(every, F.lit(0).cast("long"), lambda a, s: a + F.when(s.bitwiseAND(p) == s, F.get(F.col(poly), s)).otherwise(0)))


def audit(counts: DataFrame, filters: tuple[Filter, ...] = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``mask_counts``.

    ``shapley`` is the filter's Shapley value times the number of orders.  The
    partial derivative of a monomial of k variables is t^(k-1) on the diagonal
    and integrates to 1/k; the number of orders is a multiple of every k, so all
    rationals have it as their denominator and the values are exact integers.
    No counts: no rows.
    """
    n, size = len(filters), 1 << len(filters)
    names = "".join(f.name for f in filters)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"), F.sum("n").alias("total"))
    solved = parts.select("part", "total", *[_polynomial(F.col("c"), f, size).alias(f"p_{f}") for f in ("n", "good", "toxic")])
    # Written, so that orders and steps read corners instead of working them out again.
    solved = durable(solved.select("part", "total", F.col("p_n").alias("poly"), *[_corners(f"p_{f}", size).alias(f) for f in ("n", "good", "toxic")]), "audit-corners")
    orders = F.explode(F.array(*[F.lit("".join(o)) for o in permutations(names)]))
    steps = solved.select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    bit = lambda at: F.expr(f"shiftleft(1, instr('{names}', substr(filter_order, {at}, 1)) - 1)")
    after = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda a, j: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), F.instr(F.lit(names), F.substr(F.col("filter_order"), j, F.lit(1))) - 1)))
    placed = steps.withColumns({"b": bit("step"), "after": after}).withColumn("before", F.col("after").bitwiseXOR(F.col("b")))
    gain = lambda c: F.get(F.col(c), F.col("after")) - F.get(F.col(c), F.col("before"))
    share = F.aggregate(F.sequence(F.lit(1), F.lit(size - 1)), F.lit(0).cast("long"), lambda a, s: a + F.when(s.bitwiseAND(F.col("b")) != 0, F.get(F.col("poly"), s) * F.expr(str(factorial(n))) / F.bit_count(s)).otherwise(0).cast("long"))
    return placed.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), (F.col("total") - F.get("n", F.col("after"))).alias("kept"), gain("n").alias("removed"),
        (F.get("poly", F.col("b")) - gain("n")).alias("redundant"),
        (F.get("n", F.lit(size - 1)) - F.get("n", F.lit(size - 1).bitwiseXOR(F.col("b")))).alias("unique_fails"),
        gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"), share.alias("shapley"),
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), least AS (
  SELECT text, min(doc_id) AS first_id FROM t GROUP BY text
), m AS (
  SELECT doc_id, part, len(w) < 100 AS A, 100 * len(list_distinct(w)) < 80 * len(w) AS B,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS C,
         regexp_matches(text, '[#$%&*|]') AS D, coalesce(doc_id > first_id, false) AS E
  FROM t JOIN least USING (text)
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, (A::INT + 2 * B::INT + 4 * C::INT + 8 * D::INT + 16 * E::INT) AS mask, count(*) AS n,
         count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (
  SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bs FROM f f1, f f2, f f3, f f4, f f5
  WHERE f1.b | f2.b | f3.b | f4.b | f5.b = 31
), s AS (
  SELECT filter_order, k AS step, bs[k] AS b, coalesce(list_sum(bs[1:k - 1]), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
), r AS (
  SELECT part, filter_order, step, b, sum(CASE WHEN mask & (before | b) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & b <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & b <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = b THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & b <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & b <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley
FROM r
"""
