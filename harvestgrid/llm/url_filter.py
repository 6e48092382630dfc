"""URL verdicts from rules and, where no rule fits, from boosted trees on lexical features.

Everything runs on DataFrame functions and Spark ML. The trees are trained on the URLs that the rules label, on
at most ``TRAINING_ROWS`` of them (a bounded sample by hash; the bound is a parameter); suffix statistics
are taken over all labelled URLs.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labelled urls that train the trees, on average at most; and of each class, if it has them, at least.
TRAINING_ROWS, LEAST_ROWS = 100_000, 100
TREES, DEPTH = 20, 4
FEATURES = (
    "f_length",
    "f_host_length",
    "f_depth",
    "f_labels",
    "f_digits",
    "f_entropy",
    "f_params",
    "f_marks",
    "f_suffix_rate",
    "f_suffix_share",
)
# (verdict, rule): a rule is a host and the start of a path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none or the url is null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(
        F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    rule = verdict = None
    for said, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + start))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def entropy(text: Column) -> Column:
    """Bits per character of a text, from the shares of its characters; 0 for the empty text."""
    size = F.length(text)
    shares = F.transform(
        F.array_distinct(F.split(text, "")), lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    )
    bits = F.aggregate(shares, F.lit(0.0), lambda a, p: F.when(p > 0, a - p * F.log2(p)).otherwise(a))
    return F.when(size > 0, bits).otherwise(0.0)


def _lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    size = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "f_length": F.length(url).cast("double"),
        "f_host_length": F.length(host).cast("double"),
        "f_depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double"),
        "f_labels": F.size(F.split(host, r"\.")).cast("double"),
        "f_digits": F.regexp_count(url, F.lit(r"[0-9]")) / size,
        "f_entropy": entropy(url),
        "f_params": F.size(F.filter(F.split(query, "[&;]"), lambda s: s != "")).cast("double"),
        "f_marks": F.regexp_count(url, F.lit(r"[^A-Za-z0-9/.:]")).cast("double"),
        "suffix": F.element_at(F.split(host, r"\."), -1),
    }


def url_verdicts(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, training_rows: int = TRAINING_ROWS
) -> DataFrame:
    """Judge every row: (page_id, host, path, rule, verdict, score).

    Host and path of a url that is null or has no ``://`` are empty. ``rule`` is the longest one that fits, else null;
    ``verdict`` is its verdict, else the trees' (block from a score of 0.5). ``score`` is the trees' probability of
    a block, for all rows. If the rules label no url, the score is 0; if they label all alike, it is 0 or 1.
    Ids are carried, not used: repeated rows and null ids have rows like any other. Other columns are not read.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    rule, said = best_rule(F.col("host"), F.col("path"), rules)
    judged = (
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
        .withColumns({"host": host_of(url), "path": path_of(url)})
        .withColumns({"rule": rule, "said": said, "blocked": (said == "block").cast("double")})
        .withColumn("place", F.monotonically_increasing_id())
        .withColumns(_lexical(url, F.col("host"), F.col("path")))
    )
    labelled = judged.where("said IS NOT NULL")
    total, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0.0))).first()
    if blocked in (0, total):
        scored = judged.withColumn("score", F.lit(float(total > 0 and blocked == total)))
    else:
        rate = blocked / total
        suffixes = labelled.groupBy("suffix").agg(F.sum("blocked").alias("s_blocked"), F.count("*").alias("s_count"))
        # A labelled url's own label has no part in the rate of its suffix.
        own = F.coalesce("blocked", F.lit(0.0)), F.when(F.col("said").isNotNull(), 1).otherwise(0)
        rows = (
            judged.join(suffixes, "suffix", "left")
            .fillna({"s_blocked": 0.0, "s_count": 0})
            .withColumn("f_suffix_rate", (F.col("s_blocked") - own[0] + rate) / (F.col("s_count") - own[1] + 1))
            .withColumn("f_suffix_share", F.col("s_count") / F.lit(float(total)))
        )
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        # The place in the input deals repeated rows; a rare class has some rows in any case.
        drawn = F.pmod(F.xxhash64("page_id", "url", "place"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        shares = [min(1.0, max(training_rows / total, LEAST_ROWS / of)) for of in (blocked, total - blocked)]
        sample = rows.where("said IS NOT NULL").where(drawn < F.when(F.col("blocked") == 1, shares[0]).otherwise(shares[1]))
        trees = GBTClassifier(labelCol="blocked", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=7)
        scored = trees.fit(sample).transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "score",
    )
