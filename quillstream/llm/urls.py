"""URL filter: host and path rules, and a character language-model ratio for URLs that no rule decides.

Two smoothed variable-order Markov models (contexts of up to ORDER characters, each order interpolated
with the next lower one by Witten-Bell weights) are counted from the URLs that rules accept and those they
reject. A URL's score is the difference of its log-likelihoods divided by its length; it is blocked if
the score is at or above the threshold that best parts the two training sets (largest sum of the shares
judged rightly, the lowest such threshold). Everything is DataFrame expressions.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and has
score 0; repeated URLs weigh as often as they occur and get equal verdicts; where either training set is
empty the scores are 0 and the verdict is allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (rule, verdict) of the registered query.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
ORDER = 3
ALPHABET = 256.0
CUTS = 50.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(longest rule that fits or null, its verdict or null)."""
    name = verdict = None
    for rule, v in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def grams(urls: DataFrame) -> DataFrame:
    """(every column of urls, gram): a gram is a character after up to ORDER before it; \\u0002 stands before the first, \\u0003 ends."""
    padded = F.concat(F.lit("\u0002" * ORDER), F.col("text"), F.lit("\u0003"))
    return urls.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("text") + 1))).withColumn("gram", F.substr(padded, F.col("at"), F.lit(ORDER + 1))).drop("at", "text")


def log_ratios(counted: DataFrame) -> DataFrame:
    """counted (gram, blocked, allowed: weighted occurrences in training, 0 where a gram is only scored) to (gram, ratio).

    For each order the counts of a context and of its characters come from aggregates over grams' suffixes.
    """
    now = counted.select("gram", "blocked", "allowed")
    p = {"blocked": F.lit(1.0 / ALPHABET), "allowed": F.lit(1.0 / ALPHABET)}
    for o in range(ORDER + 1):
        suffix, ctx = F.substr("gram", F.lit(ORDER + 1 - o)), F.substr("gram", F.lit(ORDER + 1 - o), F.lit(o))
        seen = counted.groupBy(suffix.alias("s")).agg(F.sum("blocked").alias("nb"), F.sum("allowed").alias("na"))
        ends = seen.groupBy(F.substr("s", F.lit(1), F.lit(o)).alias("c")).agg(F.sum("nb").alias("tb"), F.sum("na").alias("ta"), F.sum((F.col("nb") > 0).cast("double")).alias("qb"), F.sum((F.col("na") > 0).cast("double")).alias("qa"))
        now = now.withColumn("s", suffix).withColumn("c", ctx).join(seen, "s").join(ends, "c")
        for x, n, t, q in (("blocked", "nb", "tb", "qb"), ("allowed", "na", "ta", "qa")):
            lower = F.lit(1.0 / ALPHABET) if o == 0 else F.col(f"p_{x}")
            now = now.withColumn(f"p_{x}", F.when(F.col(t) > 0, (F.col(n) + F.col(q) * lower) / (F.col(t) + F.col(q))).otherwise(lower))
        now = now.select("gram", "blocked", "allowed", "p_blocked", "p_allowed")
    return now.select("gram", (F.log("p_blocked") - F.log("p_allowed")).alias("ratio"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (page_id, url) to (page_id, host, path, rule, verdict, score, threshold)."""
    host, path = host_and_path(F.col("url"))
    d = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    d = d.withColumn("rule", rule).withColumn("ruled", ruled)
    # One row for each different text: a text has one rule, and so one training set.
    texts = d.groupBy(F.concat("host", "path").alias("text"), "host", "path", "ruled").agg(F.count("*").cast("double").alias("n")).filter("text <> ''")
    keyed = texts.withColumn("key", F.struct("host", "path"))
    rows = grams(keyed.select("key", "text", "ruled", "n"))
    counted = rows.groupBy("gram").agg(F.sum(F.when(F.col("ruled") == "block", F.col("n")).otherwise(0.0)).alias("blocked"), F.sum(F.when(F.col("ruled") == "allow", F.col("n")).otherwise(0.0)).alias("allowed"))
    scored = rows.select("key", "ruled", "n", "gram").join(log_ratios(counted), "gram").groupBy("key", "ruled", "n").agg(F.round(F.avg("ratio"), 9).alias("score"))
    scored = scored.select(F.col("key.host").alias("h"), F.col("key.path").alias("p"), "ruled", "n", "score")
    cut = threshold(scored.filter("ruled is not null"))
    out = d.join(scored.select("h", "p", "score"), (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").withColumn("threshold", cut.scalar())
    score = F.when(F.col("threshold").isNull(), F.lit(0.0)).otherwise(F.coalesce("score", F.lit(0.0)))
    verdict = F.coalesce("ruled", F.when(F.col("threshold").isNotNull() & (F.col("host") != "") & (F.col("score") >= F.col("threshold")), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round(score, 6).alias("score"), "threshold")


def threshold(trained: DataFrame) -> DataFrame:
    """One row (threshold): scores in steps of 1 / CUTS; null where a training set is empty.

    Scores per character lie within the logarithm of the smallest probability, so there are at most some hundreds of steps.
    """
    step = trained.groupBy(F.floor(F.col("score") * CUTS).alias("step")).agg(F.sum(F.when(F.col("ruled") == "block", F.col("n")).otherwise(0.0)).alias("b"), F.sum(F.when(F.col("ruled") == "allow", F.col("n")).otherwise(0.0)).alias("a"))
    rows = F.array_sort(F.collect_list(F.struct("step", "b", "a")))
    all_ = step.agg(rows.alias("r"), F.sum("b").alias("tb"), F.sum("a").alias("ta"))
    each = all_.select("tb", "ta", F.explode_outer(F.transform(F.col("r"), lambda x: F.struct(x["step"].alias("step"), F.aggregate(F.filter(F.col("r"), lambda y: y["step"] >= x["step"]), F.lit(0.0), lambda s, y: s + y["b"]).alias("right_b"), F.aggregate(F.filter(F.col("r"), lambda y: y["step"] < x["step"]), F.lit(0.0), lambda s, y: s + y["a"]).alias("right_a")))).alias("x"))
    gain = F.round(F.try_divide(F.col("x.right_b"), F.col("tb")) + F.try_divide(F.col("x.right_a"), F.col("ta")), 9)
    return each.agg(F.max_by(F.when(gain.isNotNull(), F.col("x.step")), F.struct(gain, -F.col("x.step"))).alias("s")).select((F.col("s") / CUTS).alias("threshold"))


def pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
