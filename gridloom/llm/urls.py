"""URL filters: host segmentation and naive Bayes.

Host labels such as ``cheappills`` are split into words by a Viterbi search
under a unigram model, and a multinomial naive Bayes scores the words of host
and path.  The unigrams are counted over all pages; a label only ever meets
the counts of its own substrings, so no vocabulary is broadcast.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.plans.durable import durable
from gridloom.plans.session import bounded_batches

#: Words that mark a page as unwanted where the model's training labels come from.
SEEDS = ("ads", "adult", "bets", "casino", "cheap", "free", "gambling", "loan", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "viagra", "xxx")
#: The site rules, host and path prefix, longest first wins.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: digits, lower-case letters and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = "[" + WORD[2:]
#: Longer words are looked up by their first so many characters.
STEM = 20


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for h, p, _ in ordered]
    return F.coalesce(*[F.when(f, F.lit(h + p)) for f, (h, p, _) in zip(fits, ordered)]), F.coalesce(*[F.when(f, F.lit(v)) for f, (_, _, v) in zip(fits, ordered)])


def words_of(text: Column) -> Column:
    """The words of a text, host or path, in order and as often as they occur."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _BETWEEN), "")


def segment(label: str, counts: dict[str, int], total: int) -> list[str]:
    """Most likely split of a label into words of any length; ties go to the longest last word.

    A word that was never counted is as likely as ``10 / (total * 10 ** length)``.
    """
    unit, lengths = math.log(10), sorted({len(w) for w in counts}, reverse=True)
    unseen = math.log(10 / total)
    best: list[tuple[float, int]] = [(0.0, 0)]
    # An unseen word may begin anywhere: that is best where best[begin] + begin * unit is largest.
    top = (0.0, 0)
    for end in range(1, len(label) + 1):
        found = (top[0] + unseen - end * unit, top[1])
        for n in lengths:
            if n <= end and (times := counts.get(label[end - n : end])):
                cost = best[end - n][0] + math.log(times / total)
                if cost > found[0] + 1e-9 or (abs(cost - found[0]) <= 1e-9 and end - n < found[1]):
                    found = (cost, end - n)
        best.append(found)
        if found[0] + end * unit > top[0] + 1e-9:
            top = (found[0] + end * unit, end)
    words, end = [], len(label)
    while end:
        begin = best[end][1]
        words.append(label[begin:end])
        end = begin
    return words[::-1]


def unigrams(texts: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` over all texts."""
    return texts.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def segment_labels(labels: DataFrame, words: DataFrame) -> DataFrame:
    """``label, words`` for distinct ``label`` under the unigrams ``word, n``.

    Every substring of a label that is a word counts.  A label is cut once, into
    the ``STEM`` characters from each of its places, which travel with a digest
    of it; their beginnings are joined with the words of up to ``STEM``
    characters.  A longer word whose first ``STEM`` characters occur is handed to
    the label's search as well, where it counts only if it stands there whole.
    """
    total = int(words.agg(F.sum("n")).first()[0] or 1)
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.length("label"), F.lit(1))), lambda b: F.substring(F.col("label"), b, F.lit(STEM)))
    named = labels.select(F.unhex(F.md5("label")).alias("lid"), "label")
    stems = durable(named.select("lid", F.explode(F.array_distinct(places)).alias("stem")), "url-stems")
    pieces = stems.select("lid", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("stem"), F.lit(1))), lambda k: F.substring(F.col("stem"), F.lit(1), k))).alias("word"))
    short = pieces.distinct().join(words, "word").select("lid", "word", "n")
    long_ = words.filter(F.length("word") > STEM).withColumn("stem", F.substring("word", 1, STEM))
    far = stems.join(long_, "stem").select("lid", "word", "n")
    known = short.union(far).groupBy("lid").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(label: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([segment(x, dict(c) if c is not None else {}, total) for x, c in zip(label, counts)])

    return bounded_batches(named).join(known, "lid", "left").select("label", split("label", F.col("counts")).alias("words"))


def bayes(tokens: DataFrame, seeds: tuple[str, ...] = SEEDS, alpha: float = 0.5) -> tuple[DataFrame, float]:
    """``token, weight`` (log odds of block against allow) and the log odds of the prior.

    ``tokens`` has ``tokens, n``: the token lists and how many pages have them.
    The model is multinomial: a token counts as often as it occurs.  A list
    that holds a seed word trains as block.
    """
    marked = tokens.withColumn("bad", F.arrays_overlap("tokens", F.array(*[F.lit(s) for s in seeds])))
    split = [F.sum(F.when(c, F.col("n")).otherwise(0)).alias(x) for c, x in ((F.col("bad"), "b"), (~F.col("bad"), "a"))]
    each = marked.select("bad", "n", F.explode("tokens").alias("token")).groupBy("token").agg(*split)
    sb, sa, v = (float(x or 0) for x in each.agg(F.sum("b"), F.sum("a"), F.count("*")).first())
    b, a = (float(x or 0) for x in marked.agg(*split).first())
    odds = F.log((F.col("b") + alpha) / (sb + alpha * max(v, 1))) - F.log((F.col("a") + alpha) / (sa + alpha * max(v, 1)))
    return each.select("token", odds.alias("weight")), math.log((b + alpha) / (a + alpha))


def judge(pages: DataFrame, rules: tuple = RULES, seeds: tuple[str, ...] = SEEDS, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every input row.

    The verdict is the rule's where one fits, else block where the log odds of
    the segmented host and path tokens are above zero.  Null urls and urls
    without ``://`` have an empty host and path and are scored by the prior.
    Repeated rows are judged each.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    base = durable(pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path")), "url-parts")
    words = durable(unigrams(pages.select(F.regexp_replace(F.coalesce(F.col(body), F.lit("")), r"<[^>]*>", " ").alias("text"))), "url-unigrams")
    hosts = base.groupBy("host").agg(F.count("*").alias("n"))
    parts = durable(hosts.select("host", F.posexplode_outer(words_of(F.col("host"))).alias("i", "label")), "url-labels")
    split = segment_labels(parts.filter("label IS NOT NULL").select("label").distinct(), words)
    segmented = durable(
        parts.join(split, "label", "left").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "words"))), lambda x: F.coalesce(x["words"], F.array().cast("array<string>")))).alias("host_tokens")),
        "url-hosts",
    )
    path_tokens = words_of(F.col("path"))
    lists = durable(base.select("host", path_tokens.alias("path_tokens")).groupBy("host", "path_tokens").agg(F.count("*").alias("n")), "url-lists")
    tokens = durable(lists.join(segmented, "host").select("host", "path_tokens", F.concat("host_tokens", "path_tokens").alias("tokens"), "n"), "url-tokens")
    weights, prior = bayes(tokens, seeds)
    scored = (
        tokens.select("host", "path_tokens", F.explode("tokens").alias("token")).join(weights, "token")
        .groupBy("host", "path_tokens").agg(F.round(F.sum("weight"), 9).alias("odds"))
    )
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = base.withColumn("path_tokens", path_tokens).join(scored, ["host", "path_tokens"], "left")
    score = F.coalesce("odds", F.lit(0.0)) + F.lit(prior)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(score > 0, F.lit("block")).otherwise("allow")).alias("verdict"), score.alias("score"))
