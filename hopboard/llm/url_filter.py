"""URL filter: rules first, then a ratio of two character language models, as DataFrame operations only.

URLs that a rule allows or blocks train two smoothed Markov models of variable order. A model predicts the
next symbol from up to three before it; each order is interpolated with the next lower one by the number
of different symbols seen in the context (Witten-Bell), down to equal chances. A URL's score is the
mean over its symbols of the difference of the two log-likelihoods, so long URLs are not favoured. A fifth
of the URLs is kept out of the counts; on those that have a rule, the threshold is set where the shares of
rightly allowed and rightly blocked ones are largest together.

URLs are written in 40 symbols: a-z, one for all digits, some marks, one for anything else, and one each
for the start and the end. So there are at most 40**4 = 2,560,000 sequences of four symbols; the table of
their scores is bounded by that (some 80 MB) whatever the input, and is sent to the tasks.

Defined cases: a null URL, or one without "://", has an empty host and path, so no rule fits; a null URL
scores as an empty text. Without rule-labelled URLs of both kinds the threshold is 0. Repeated rows are
each judged. Other columns than page_id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = 3
SYMBOLS = 40
HELD_OUT = 5
BINS = 100

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# With a-z, the digit sign 0, the sign * for others and < and > for the ends these are 40 symbols.
_MARKS = "/.-_?=&#%:"

Rule = tuple[str, str, str]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def fitting_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """Number in `rules` of the longest (verdict, host, path) that fits, or null."""
    longest_first = sorted(range(len(rules)), key=lambda i: -len(rules[i][1] + rules[i][2]))
    tests = []
    for i in longest_first:
        _, rule_host, rule_path = rules[i]
        tests.append(F.when(((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path), F.lit(i)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("int")


def _grams(rows: DataFrame) -> DataFrame:
    """The rows once for each symbol of the URL, with the symbol and the three before it."""
    known = F.translate(lower_ascii(F.coalesce("url", F.lit(""))), "123456789", "000000000")
    written = F.concat(F.lit("<" * ORDER), F.regexp_replace(known, rf"[^a-z0{_MARKS.replace('-', chr(92) + '-')}]", "*"), F.lit(">"))
    return (
        rows.withColumn("symbols", written)
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.length("symbols") - ORDER)))
        .withColumn("gram", F.expr(f"substring(symbols, at, {ORDER + 1})"))
        .drop("symbols")
    )


def _probabilities(grams: DataFrame, count: str) -> DataFrame:
    """(gram, p) by the model of one class, for grams with counts of which some are 0."""
    orders = []
    for order in range(ORDER + 1):
        ending = F.expr(f"right(gram, {order + 1})").alias("seen")
        seen = grams.groupBy(ending).agg(F.sum(count).alias("n"))
        before = F.expr(f"left(seen, {order})")
        contexts = seen.groupBy(before.alias("context")).agg(
            F.sum("n").alias("of"), F.count(F.when(F.col("n") > 0, True)).alias("kinds")
        )
        rows = seen.join(contexts, before == F.col("context"))
        if not order:
            p = (F.col("n") + F.col("kinds") / SYMBOLS) / (F.col("of") + F.col("kinds"))
            orders.append(rows.select("seen", F.when(F.col("of") > 0, p).otherwise(1 / SYMBOLS).alias("p")))
            continue
        shorter = orders[-1].select(F.col("seen").alias("ending"), F.col("p").alias("less"))
        rows = rows.join(shorter, F.expr(f"right(seen, {order})") == F.col("ending"))
        p = (F.col("n") + F.col("kinds") * F.col("less")) / (F.col("of") + F.col("kinds"))
        orders.append(rows.select("seen", F.when(F.col("of") > 0, p).otherwise(F.col("less")).alias("p")))
    return orders[-1].select(F.col("seen").alias("gram"), "p")


def gram_scores(labelled: DataFrame) -> DataFrame:
    """(gram, ratio) for every sequence in the URLs of (url, allowed): the difference of its log-likelihoods."""
    counts = _grams(labelled.select("url", "allowed")).groupBy("gram").agg(
        F.count(F.when(F.col("allowed"), True)).alias("accepted"), F.count(F.when(~F.col("allowed"), True)).alias("rejected")
    )
    accepted = _probabilities(counts, "accepted").withColumnsRenamed({"p": "p_accepted"})
    rejected = _probabilities(counts, "rejected").withColumnsRenamed({"p": "p_rejected"})
    return accepted.join(rejected, "gram").select("gram", (F.log("p_accepted") - F.log("p_rejected")).alias("ratio"))


def _threshold(scored: DataFrame) -> float:
    """Where rightly allowed and rightly blocked shares are largest together, midway between two bins of scores."""
    bins = scored.groupBy(F.round(F.col("score") * BINS).alias("bin")).agg(
        F.sum(F.col("allowed").cast("bigint")).alias("good"), F.sum((~F.col("allowed")).cast("bigint")).alias("bad")
    )
    above, everything = Window.partitionBy().orderBy(F.desc("bin")), Window.partitionBy()
    gain = F.sum("good").over(above) / F.sum("good").over(everything) - F.sum("bad").over(above) / F.sum("bad").over(everything)
    usable = (F.sum("good").over(everything) > 0) & (F.sum("bad").over(everything) > 0)
    below = F.coalesce(F.lead("bin").over(above), F.col("bin") - 1)
    middles = bins.select(((F.col("bin") + below) / (2 * BINS)).alias("middle"), F.when(usable, gain).alias("gain"))
    best = middles.where("gain is not null").orderBy(F.desc("gain"), F.abs("middle"), "middle").first()
    return best["middle"] if best else 0.0


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per page: page_id, url, host, path, rule, score, threshold, verdict."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rows = rows.withColumn("rule_no", fitting_rule(rules, F.col("host"), F.col("path")))
    verdicts = F.array(*[F.lit(verdict) for verdict, _, _ in rules] or [F.lit(None).cast("string")])
    names = F.array(*[F.lit(rule_host + rule_path) for _, rule_host, rule_path in rules] or [F.lit(None).cast("string")])
    rows = rows.withColumn("allowed", F.get(verdicts, F.col("rule_no")) == "allow")
    counted = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) != 0
    # Sequences of all URLs get a score; those without a rule or kept out count for neither class.
    ratios = gram_scores(rows.withColumn("allowed", F.when(counted, F.col("allowed"))))
    keys = ["page_id", "url", "host", "path", "rule_no", "allowed"]
    scored = (
        _grams(rows).join(F.broadcast(ratios), "gram")
        .groupBy(*keys)
        # Repeated rows have one mean; the first symbols tell how many rows they are.
        .agg(F.round(F.avg("ratio"), 9).alias("score"), F.count(F.when(F.col("at") == 1, True)).cast("int").alias("copies"))
    )
    threshold = _threshold(scored.where(~counted & F.col("allowed").isNotNull()))
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return (
        scored.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        .select(
            "page_id", "url", "host", "path", F.get(names, F.col("rule_no")).alias("rule"), "score",
            F.lit(threshold).alias("threshold"), F.coalesce(F.get(verdicts, F.col("rule_no")), by_model).alias("verdict"),
        )
    )
