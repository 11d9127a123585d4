"""URL filters: rules by host and path, and for all other URLs a character language-model ratio.

Two variable-order Markov models, of the URLs that rules allow and of those that rules block, give each character a
probability after up to three characters; each order is smoothed by the order below (``PSEUDO`` pseudo-counts), the lowest
by even chances. A URL's score is the mean log-likelihood difference of its characters. It is calibrated on
labelled URLs that the models have not seen: the threshold lies between the mean scores of both labels, divided as
their deviations are.

The alphabet is folded to ``ALPHABET`` and three marks, so a model has at most 34 ** 4 different contexts with a
character however many URLs there are: that bounds the table of differences that is broadcast. Differences are whole millionths,
so sums agree in every order. Every different labelled URL is learned from or calibrates. Only DataFrame functions are used.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by its
characters (none: only the end mark); without URLs of both labels the threshold is zero and a score of zero allows; equal
URLs get equal results; ids may be null or repeat; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlens.llm import common

#: Fixed values of the contract, as (verdict, host and path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
MOST_RULES, PSEUDO, ORDER = 1000, 4.0, 3
#: A caller may bound how many labelled URLs are learned from; None takes them all.
TRAIN_URLS: int | None = None
#: After folding: lower-case letters, one digit, and the marks that divide a URL. Others are ``?``.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./:-"
START, END, OTHER = "^", "$", "?"
UNIT = 1_000_000


def host_of(url: Column) -> Column:
    return F.coalesce(common.lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or one of its subdomains, and the path."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def with_grams(urls: DataFrame) -> DataFrame:
    """A row for each character of the folded ``url``, and for its end, with ``gram``: it and the three before it.

    The characters are a column of their own: inside the lambda the split would be done anew for each of them.
    """
    low = F.translate(F.lower(F.coalesce("url", F.lit(""))), "123456789", "000000000")
    folded = F.regexp_replace(low, r"(?s)[^a-z0./:\-]", OTHER)
    chars = F.split(F.concat(F.lit(START * ORDER), folded, F.lit(END)), "")
    grams = F.transform(
        F.sequence(F.lit(0), F.size("__chars") - ORDER - 1),
        lambda i: F.concat(F.get("__chars", i), F.get("__chars", i + 1), F.get("__chars", i + 2), F.get("__chars", i + 3)),
    )
    return urls.withColumn("__chars", chars).withColumn("gram", F.explode(grams)).drop("__chars")


@dataclass
class Model:
    """``table`` (gram, gain) in millionths, ``threshold`` likewise."""

    table: DataFrame
    threshold: int


def _labelled(urls: DataFrame, rules, train_urls: int | None) -> DataFrame:
    """(url, accepted, held): the URLs that a rule judges, half of them held for calibration; a sample only if ``train_urls`` is given."""
    ruled = urls.withColumn("verdict", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)[1]).filter("verdict is not null")
    ruled = common.store(ruled.select("url", (F.col("verdict") == "allow").alias("accepted")), "ruled")
    if train_urls is not None:
        ruled = ruled.filter(common.sampled(F.col("url"), min(1.0, train_urls / max(1, ruled.count()))))
    return ruled.withColumn("held", F.pmod(F.xxhash64(F.lit("half"), "url"), F.lit(2)) == 1)


def gain_table(counts: DataFrame, pseudo: float = PSEUDO) -> DataFrame:
    """(gram, gain) for the grams of ``counts`` (gram, accepted, rejected): the log of the models' ratio for the last character."""
    labels = ("accepted", "rejected")
    size = len(ALPHABET) + 2  # END and OTHER; START is never predicted
    table = counts.select("gram", *[F.lit(1.0 / size).alias(f"p_{label}") for label in labels])
    for order in range(ORDER + 1):
        # How often the last character, and how often any, follows the ``order`` characters before it.
        tail = F.substring("gram", ORDER + 1 - order, order + 1)
        after = F.substring("gram", ORDER + 1 - order, order)
        both = counts.groupBy(tail.alias("tail")).agg(*[F.sum(label).alias(f"n_{label}") for label in labels])
        context = counts.groupBy(after.alias("after")).agg(*[F.sum(label).alias(f"all_{label}") for label in labels])
        table = table.withColumns({"tail": tail, "after": after}).join(both, "tail").join(context, "after")
        table = table.select(
            "gram",
            *[((F.col(f"n_{x}") + pseudo * F.col(f"p_{x}")) / (F.col(f"all_{x}") + pseudo)).alias(f"p_{x}") for x in labels],
        )
    gain = F.round(F.log(F.col("p_accepted") / F.col("p_rejected")) * UNIT).cast("long")
    return table.select("gram", gain.alias("gain"))


def scores(urls: DataFrame, table: DataFrame) -> DataFrame:
    """The rows of ``urls``, different in all columns, with ``score``: the mean gain of a URL's characters, in millionths."""
    each = with_grams(urls)
    # At most 34 ** 4 short rows.
    summed = each.join(F.broadcast(table), "gram").groupBy(*urls.columns).agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("n"))
    return summed.withColumn("score", F.round(F.col("gain") / F.col("n")).cast("long")).drop("gain", "n")


def train(urls: DataFrame, rules=RULES, train_urls: int | None = TRAIN_URLS) -> Model:
    """Fit on ``urls`` (url, all different). Grams that only occur elsewhere have counts of zero."""
    labelled = _labelled(urls, rules, train_urls)
    seen = with_grams(labelled.filter("not held").select("accepted", "url"))
    seen = seen.groupBy("gram").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
    others = with_grams(urls).groupBy("gram").agg(F.lit(0).cast("long").alias("accepted"))
    counts = seen.unionByName(others.withColumn("rejected", F.col("accepted"))).groupBy("gram")
    counts = common.store(counts.agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "gram_counts")
    table = common.store(gain_table(counts), "gains")
    held = scores(labelled.filter("held").select("url", "accepted"), table).groupBy("accepted")
    found = {r.accepted: r for r in held.agg(F.avg("score").alias("mean"), F.coalesce(F.stddev("score"), F.lit(0.0)).alias("spread")).collect()}
    threshold = 0
    if len(found) == 2:
        good, bad = found[True], found[False]
        width = good.spread + bad.spread
        threshold = round((bad.mean * good.spread + good.mean * bad.spread) / width if width else (good.mean + bad.mean) / 2)
    return Model(table, threshold)


def judge(pages: DataFrame, rules=RULES, train_urls: int | None = TRAIN_URLS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every URL; ``score`` less the threshold, null where a rule decides."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = common.store(common.spread(rows.select("url").distinct(), "url"), "urls")
    model = train(urls, rules, train_urls)
    parts = urls.select("url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "by_rule": verdict})
    scored = scores(ruled.filter("rule is null").select("url"), model.table).withColumn("score", F.col("score") - model.threshold)
    by_model = F.when(F.col("score") >= 0, "allow").otherwise("block")
    judged = ruled.join(scored.withColumnRenamed("url", "of"), F.col("url").eqNullSafe(F.col("of")), "left").select(
        F.col("url").alias("judged"), "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), (F.col("score") / UNIT).alias("score")
    )
    judged = common.store(judged, "judged")
    return rows.join(judged, rows.url.eqNullSafe(judged.judged)).select("page_id", "host", "path", "rule", "verdict", "score")
