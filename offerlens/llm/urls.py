"""URL filters: fixed rules first, then gradient-boosted trees on lexical features (operator 7, DataFrame functions only).

Urls that a rule decides are the labelled ones; the trees learn from a bounded sample of them and judge the others.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Labelled urls that the trees learn from: distinct ones of smallest hash, at most about half as many of each verdict.
TRAIN_ROWS = 20_000
FEATURES = ["url_length", "host_length", "path_length", "depth", "digit_ratio", "dot_count", "hyphen_count", "param_count", "entropy", "has_fragment", "has_extension", "labels", "first_label_length", "suffix_share", "log_suffix_count"]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    rest = after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as a struct of rule and verdict, or null.  Of equally long ones the first counts."""
    out = F.lit(None)
    for h, p, verdict in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def features(rows: DataFrame) -> DataFrame:
    """Lexical features of url, host and path.  A suffix is the host's last two labels; its count is over all rows."""
    url, n = F.coalesce("url", F.lit("")), F.length(F.coalesce("url", F.lit(""))).cast("double")
    count = lambda pattern: F.regexp_count(url, F.lit(pattern)).cast("double")
    # entropy of the characters: log2 n less the sum over distinct characters of k log2 k / n
    times = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))).cast("double")
    distinct = F.filter(F.array_distinct(F.split(url, "")), lambda c: c != "")
    spent = F.aggregate(distinct, F.lit(0.0), lambda acc, c: acc + times(c) * F.log2(times(c)))
    own = rows.withColumns({
        "suffix": F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1), "url_length": n, "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": F.regexp_count("path", F.lit("/[^/]+")).cast("double"), "digit_ratio": share(count("[0-9]"), n), "dot_count": count(r"\."), "hyphen_count": count("-"), "param_count": count("[?&][^?&#]+"),
        "entropy": F.when(n > 0, F.log2(n) - spent / n).otherwise(0.0), "has_fragment": url.contains("#").cast("double"), "has_extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
        "labels": F.size(F.split("host", r"\.")).cast("double"), "first_label_length": F.length(F.regexp_extract("host", r"^([^.]*)", 1)).cast("double"),
    })
    counts = own.groupBy("suffix").agg(F.count(F.lit(1)).cast("double").alias("suffix_count"))
    total = counts.agg(F.sum("suffix_count").alias("total"))
    return own.join(counts, "suffix").crossJoin(F.broadcast(total)).withColumns({"suffix_share": F.col("suffix_count") / F.col("total"), "log_suffix_count": F.log1p("suffix_count")}).drop("total")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the trees' probability of block for the unruled.

    Null urls and those without :// have empty host and path and no rule.  Repeated rows each get a row.  Where no
    rule decides, the trees do; without labelled urls of both kinds (or in an empty table) those urls are allowed, as
    nothing was learned.  Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumns({"host": F.coalesce(host_of(F.col("url")), F.lit("")), "path": F.coalesce(path_of(F.col("url")), F.lit(""))})
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    named = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(rows))
    labelled = named.where(F.col("hit").isNotNull()).withColumn("label", (F.col("hit.verdict") == "block").cast("double"))
    kinds = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.approx_count_distinct("url").alias("n")).collect()}
    base = ["page_id", "host", "path", F.col("hit.rule").alias("rule")]
    if len(kinds) < 2:
        return rows.select(*base, F.coalesce("hit.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("block_probability"))
    # a bounded sample of each verdict by hash of the url: the same urls at every run, copies once
    most = {k: min(2**63 - 1, -(2**63) + int(min(1.0, train_rows / 2 / n) * 2**64)) for k, n in kinds.items()}
    sample = labelled.where(F.xxhash64("url") <= F.when(F.col("label") == 1.0, most[1.0]).otherwise(most[0.0])).dropDuplicates(["url"]).select("features", "label")
    model = GBTClassifier(maxIter=10, maxDepth=4, seed=7, cacheNodeIds=False).fit(sample.repartition(8))
    p = vector_to_array("probability")[1]
    judged = model.transform(named)
    unruled = F.when(p >= 0.5, "block").otherwise("allow")
    return judged.select(*base, F.coalesce("hit.verdict", unruled).alias("verdict"), F.when(F.col("hit").isNull(), p).alias("block_probability"))
