"""Preference formatting: one prompt, two masked completions.

Chosen and rejected conversations are compared turn by turn.  Their longest
common prefix is rendered once as the prompt; what follows on either side is
its completion, with a mask of the characters that are trained on (the
assistant's words and the mark that ends them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.durable import durable
from gridloom.plans.ranking import global_rank


@dataclass(frozen=True)
class Template:
    """A turn is rendered as ``open + role + body + text + close``."""

    open: str = "<|"
    body: str = "|>\n"
    close: str = "<|end|>\n"
    trained: str = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: one row a conversation, turns in order as ``(turn, role, text)``.

    Null roles and texts count as empty.  Ties of a turn number are ordered by
    role and text and repeated rows of one turn are one turn; rows without a
    conversation or a turn number belong nowhere and are left out.
    """
    known = turns.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return known.groupBy("conv_id").agg(F.array_sort(F.collect_set(turn)).alias("turns"))


def swapped_pairs(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """Pairs whose rejected side ends in another conversation's last reply.

    Conversations that have an assistant turn are numbered by id: 1 and 2 are
    partners, 3 and 4, and so on; the partner of an odd last one is the one
    before it.  Chosen is a conversation up to its last assistant turn;
    rejected has the partner's last assistant text there.  Conversations
    without such a turn have no reply to prefer and give no pair; one that is
    alone in the table has a null rejected side.
    """
    last = F.array_max(F.transform(F.col("turns"), lambda x, i: F.when(x["role"] == trained, i + 1)))
    ended = conversations(turns).withColumn("last", last).filter("last IS NOT NULL").select("conv_id", F.slice("turns", F.lit(1), F.col("last")).alias("chosen"))
    ended = durable(ended.withColumn("reply", F.element_at("chosen", -1)["text"]), "chat-ended")
    ranks = durable(global_rank(ended.select("conv_id"), "conv_id"), "chat-ranks")
    n = ranks.count()
    odd = F.col("rank") % 2 == 1
    partner = F.when(odd & (F.col("rank") < n), F.col("rank") + 1).otherwise(F.col("rank") - 1)
    wanted = ranks.select("conv_id", partner.alias("rank")).join(ranks.select(F.col("conv_id").alias("partner"), "rank"), "rank").drop("rank")
    reply = ended.select(F.col("conv_id").alias("partner"), F.col("reply").alias("other")).join(wanted, "partner").drop("partner")
    tail = F.element_at("chosen", -1)
    swapped = F.struct(tail["turn"].alias("turn"), tail["role"].alias("role"), F.col("other").alias("text"))
    rejected = F.when(F.col("other").isNotNull(), F.concat(F.slice("chosen", F.lit(1), F.size("chosen") - 1), F.array(swapped)))
    return ended.join(reply, "conv_id", "left").select(F.col("conv_id").alias("pair_id"), "chosen", rejected.alias("rejected"))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns, by role and text."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(
        F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
        lambda i: (i < n) & ~(F.struct(F.get(a, i)["role"], F.get(a, i)["text"]) == F.struct(F.get(b, i)["role"], F.get(b, i)["text"])),
    )
    return F.coalesce(F.try_element_at(differ, F.lit(1)), n)


def render(turns: Column, t: Template) -> Column:
    return F.concat_ws("", F.transform(turns, lambda x: F.concat(F.lit(t.open), x["role"], F.lit(t.body), x["text"], F.lit(t.close))))


def trained_spans(turns: Column, t: Template) -> Column:
    """``start:stop`` of the trained characters within the rendered turns, comma-joined."""
    fixed, head, shut = len(t.open) + len(t.body) + len(t.close), len(t.open) + len(t.body), len(t.close)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["role"]) + head
        stop = begin + F.length(x["text"]) + shut
        span = F.concat_ws(":", begin.cast("string"), stop.cast("string"))
        spans = F.when(x["role"] == t.trained, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(x["role"]) + F.length(x["text"]) + fixed).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def preferences(pairs: DataFrame, template: Template = Template()) -> DataFrame:
    """Formatted pairs from ``pair_id, chosen, rejected`` (arrays of turns).

    Returns ``pair_id, n_common, prompt``, the two completions and the spans of
    their trained characters.  Null sides count as empty conversations, null
    roles and texts as empty, and null turns aren't there; equal sides give two
    empty completions; without a common turn the prompt is empty.  One row per
    input row, no shuffle.
    """
    empty = F.array().cast("array<struct<role: string, text: string>>")

    def side(name: str) -> Column:
        turns = F.filter(name, lambda x: x.isNotNull())
        return F.coalesce(F.transform(turns, lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text"))), empty).alias(name)

    sides = pairs.select("pair_id", side("chosen"), side("rejected"))
    cut = sides.withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    parts = cut.select("pair_id", "n_common", F.slice("chosen", F.lit(1), F.col("n_common")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return parts.select(
        "pair_id",
        F.col("n_common").cast("long").alias("n_common"),
        render(F.col("p"), template).alias("prompt"),
        render(F.col("c"), template).alias("chosen"),
        trained_spans(F.col("c"), template).alias("chosen_mask"),
        render(F.col("r"), template).alias("rejected"),
        trained_spans(F.col("r"), template).alias("rejected_mask"),
    )


#: DuckDB SQL for the registered query: swapped pairs of ``conversations``, formatted.
SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM t
), l AS (
  SELECT conv_id, max(i) AS last FROM o WHERE role = 'assistant' GROUP BY conv_id
), k AS (
  SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS rank, count(*) OVER () AS many FROM l
), e AS (
  SELECT o.*, last, rank, CASE WHEN rank % 2 = 1 AND rank < many THEN rank + 1 ELSE rank - 1 END AS partner FROM o JOIN l USING (conv_id) JOIN k USING (conv_id) WHERE i <= last
), b AS (
  SELECT e.conv_id, e.i, e.last, e.role, e.text AS ct, CASE WHEN e.i = e.last THEN p.text ELSE e.text END AS rt
  FROM e JOIN e p ON p.rank = e.partner AND p.i = p.last
), n AS (
  SELECT conv_id, coalesce(min(i) FILTER (ct <> rt) - 1, max(i)) AS n_common FROM b GROUP BY conv_id
), r AS (
  SELECT conv_id, i, n_common, role, '<|' || role || '|>' || chr(10) || ct || '<|end|>' || chr(10) AS c, '<|' || role || '|>' || chr(10) || rt || '<|end|>' || chr(10) AS r
  FROM b JOIN n USING (conv_id)
), s AS (
  SELECT *, coalesce(sum(length(c)) OVER (PARTITION BY conv_id, i > n_common ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ca,
         coalesce(sum(length(r)) OVER (PARTITION BY conv_id, i > n_common ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ra
  FROM r
)
SELECT conv_id AS pair_id, any_value(n_common)::BIGINT AS n_common,
       coalesce(string_agg(c, '' ORDER BY i) FILTER (i <= n_common), '') AS prompt,
       coalesce(string_agg(c, '' ORDER BY i) FILTER (i > n_common), '') AS chosen,
       coalesce(string_agg((ca + length(role) + 5)::BIGINT || ':' || (ca + length(c))::BIGINT, ',' ORDER BY i) FILTER (i > n_common AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(r, '' ORDER BY i) FILTER (i > n_common), '') AS rejected,
       coalesce(string_agg((ra + length(role) + 5)::BIGINT || ':' || (ra + length(r))::BIGINT, ',' ORDER BY i) FILTER (i > n_common AND role = 'assistant'), '') AS rejected_mask
FROM s GROUP BY conv_id
"""
