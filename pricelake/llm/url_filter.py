"""URL filters: rules by host and path, and a character language-model ratio for URLs that no rule judges.

All of it is Spark SQL functions. Two interpolated Markov models of all orders up to ORDER (Witten-Bell smoothing: an
order counts the more against the one below, the fewer different characters follow its context) are counted from
the URLs that rules allow and block, which they read whole. A URL's score is the log-likelihood difference per character, and the threshold is
calibrated on a fold of the judged URLs that the models don't see.

Counts are of distinct URLs, weighted by their rows, so a common host costs no more than a rare one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Fixed values of the contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: The longest context, and how many different characters the lowest order expects.
ORDER, ALPHABET = 4, 256
_START, _END = "\x02", "\x03"
#: Scores are calibrated in steps of this, up to this many steps from 0.
STEP, STEPS = 0.02, 400
#: At most so many grams are taken as common.
COMMON = 10_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null and for URLs without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like ``net/``, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _grams(text: Column, order: int) -> Column:
    whole = F.concat(F.lit(_START * order), text, F.lit(_END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(whole, i, F.lit(order + 1)))


def _log_ratios(counts: DataFrame, order: int) -> DataFrame:
    """(gram, ratio): log P(last character | those before it) of the allowed less that of the blocked.

    ``counts`` has a row for every gram of order + 1 characters: gram, allow, block (counts, 0 if only others have it).
    """
    lower = None
    for k in range(order + 1):
        grams = counts.groupBy(F.right("gram", F.lit(k + 1)).alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        grams = grams.withColumn("context", F.expr(f"left(gram, {k})"))
        totals = grams.groupBy("context").agg(
            *[F.sum(c).alias(f"{c}_n") for c in ("allow", "block")], *[F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_types") for c in ("allow", "block")]
        )
        grams = grams.join(totals, "context")
        if lower is None:
            grams = grams.withColumns({f"{c}_below": F.lit(1.0 / ALPHABET) for c in ("allow", "block")})
        else:
            grams = grams.withColumn("suffix", F.right("gram", F.lit(k))).join(lower, "suffix")
        for c in ("allow", "block"):
            n, types, below = F.col(f"{c}_n"), F.col(f"{c}_types"), F.col(f"{c}_below")
            grams = grams.withColumn(f"{c}_p", F.when(n > 0, (F.col(c) + types * below) / (n + types)).otherwise(below))
        if k == order:
            return grams.select("gram", (F.log("allow_p") - F.log("block_p")).alias("ratio"))
        lower = written(grams.select(F.col("gram").alias("suffix"), F.col("allow_p").alias("allow_below"), F.col("block_p").alias("block_below")))
    raise AssertionError("order is negative")


def _threshold(judged: DataFrame) -> float:
    """The step of the score with the fewest errors on held-out URLs, each verdict weighing as much; 0 without both verdicts."""
    step = F.least(F.greatest(F.round(F.col("score") / STEP), F.lit(-STEPS)), F.lit(STEPS)).cast("int")
    rows = judged.groupBy(step.alias("step")).agg(F.sum(F.when(F.col("judged") == "allow", F.col("n"))).alias("allow"), F.sum(F.when(F.col("judged") == "block", F.col("n"))).alias("block")).collect()
    allow, block = sum(r["allow"] or 0 for r in rows), sum(r["block"] or 0 for r in rows)
    if not allow or not block:
        return 0.0
    errors = []
    for t in range(-STEPS, STEPS + 1):
        # Both shares of errors over one denominator, so that equal ones are equal.
        wrong = sum(r["allow"] or 0 for r in rows if r["step"] < t) * block + sum(r["block"] or 0 for r in rows if r["step"] >= t) * allow
        errors.append((wrong, abs(t), t))
    return (min(errors)[2] - 0.5) * STEP


def _scores(grams: DataFrame, counts: DataFrame, ratios: DataFrame) -> DataFrame:
    """(text_id, score): the mean ratio of each text's grams.

    A gram that is over a COMMON part of all, so one of COMMON at most, is broadcast, and its rows are dealt out by their text.
    """
    total = counts.agg(F.coalesce(F.sum("every"), F.lit(0))).first()[0]
    ratios = written(ratios.join(counts.select("gram", "every"), "gram"))
    common = ratios.where(F.col("every") * COMMON > F.lit(total)).select(F.col("gram").alias("_common"), F.col("ratio").alias("_ratio"))
    rest = ratios.where(F.col("every") * COMMON <= F.lit(total)).select(F.col("gram").alias("_rare"), "ratio")
    rows = grams.join(F.broadcast(common), F.col("gram") == F.col("_common"), "left")
    rows = rows.withColumn("_key", F.when(F.col("_common").isNull(), F.col("gram")).otherwise(F.concat("gram", F.lit(_START), F.col("text_id").cast("string"))))
    return rows.join(rest, F.col("_key") == F.col("_rare"), "left").groupBy("text_id").agg(F.avg(F.coalesce("_ratio", "ratio")).alias("score"))


def judged(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """A verdict on each row's url: page_id, host, path, rule, verdict (allow or block), score.

    Needs page_id and url; more columns are ignored. The rules judge host and path, the models the whole URL, query string and
    fragment too, of any length. A null url, and one without ``://``, has an empty host and path; the models judge a null one
    as an empty text. Repeated rows get equal verdicts. Where rules judge no URL one way, the threshold is 0. An empty table
    gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    text = F.coalesce("url", F.lit("")).alias("_url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), text).withColumns({"rule": rule, "judged": verdict})
    texts = rows.groupBy(F.col("_url").alias("text"), "judged").agg(F.count("*").alias("n"))
    texts = written(texts.withColumn("text_id", F.monotonically_increasing_id()).withColumn("held_out", F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(5)) == 0))
    grams = texts.select("text_id", "judged", "held_out", "n", F.explode(_grams(F.col("text"), order)).alias("gram"))
    counted = lambda what: F.sum(F.when((F.col("judged") == what) & ~F.col("held_out"), F.col("n")).otherwise(0)).alias(what)
    counts = written(grams.groupBy("gram").agg(counted("allow"), counted("block"), F.count("*").alias("every")))
    scores = _scores(grams.select("text_id", "gram"), counts, _log_ratios(counts, order))
    scores = written(texts.join(scores, "text_id").select("text", "judged", "held_out", "n", "score"))
    limit = _threshold(scores.where("held_out AND judged IS NOT NULL"))
    scores = scores.select(F.col("text").alias("_text"), F.col("judged").alias("_judged"), "score")
    same = (F.col("_url") == F.col("_text")) & F.col("judged").eqNullSafe(F.col("_judged"))
    model = F.when(F.col("score") >= limit, "allow").otherwise("block")
    return rows.join(scores, same).select("page_id", "host", "path", "rule", F.coalesce("judged", model).alias("verdict"), "score")
