"""URL verdicts: listed rules first, gradient-boosted trees on lexical features for the rest. DataFrame functions and Spark's
own boosted trees only.

The trees learn from labelled URLs: a bounded, hash-ordered sample of max_train distinct ones, half of each label where there
are enough; a URL of both labels counts for each by its share. Features: lengths, depth, digit ratio, character entropy,
parameters, and the smoothed block rates of host and file suffixes among all labelled URLs, repeated ones as often as they
occur. The table of rates is keyed by the suffix itself and is broadcast only where it was counted to be small.

Defined cases: a null url, or one without '://', has an empty host and path and fits no rule; it gets the trees' verdict like
others. Repeated rows each get their verdict; ties between rules of equal length go to the first listed. Without labelled
URLs the rest is allowed; with labels of one kind only, the rest gets that kind. Other columns of the input are ignored.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch, sized

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
PRIOR = 20.0
PARTS = "(?s)://([^/?#]*)([^?#]*)"
SUFFIXES = ("tld", "domain", "file")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(known, PARTS, 1)), F.regexp_extract(known, PARTS, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the last to be wrapped around is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def _entropy(c: Column) -> Column:
    """Shannon entropy of a string's characters, in bits."""
    n = F.length(c).cast("double")
    p = lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n
    return F.when(F.length(c) == 0, 0.0).otherwise(F.aggregate(F.array_distinct(F.split(c, "")), F.lit(0.0), lambda a, x: a - p(x) * F.log2(p(x))))


def with_features(urls: DataFrame) -> DataFrame:
    """Adds numeric features and each kind of suffix. Needs columns url, host and path."""
    u, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    query = F.regexp_extract(u, "(?s)\\?([^#]*)", 1)
    suffix = {"tld": F.substring_index(host, ".", -1), "domain": F.substring_index(host, ".", -2), "file": F.regexp_extract(path, "\\.([A-Za-z0-9]{1,8})$", 1)}
    return urls.withColumns(
        {
            "f_length": F.length(u).cast("double"),
            "f_host_length": F.length(host).cast("double"),
            "f_path_length": F.length(path).cast("double"),
            "f_depth": _count(path, "/[^/]+"),
            "f_labels": _count(host, "[^.]+"),
            "f_digits": _count(u, "[0-9]") / n,
            "f_host_digits": _count(host, "[0-9]"),
            "f_hyphens": _count(host, "-"),
            "f_params": _count(query, "[^&=]+="),
            "f_fragment": u.contains("#").cast("double"),
            "f_secure": u.startswith("https").cast("double"),
            "f_slash_end": path.endswith("/").cast("double"),
            "f_entropy": _entropy(u),
            "f_host_entropy": _entropy(host),
            **{f"s_{k}": c for k, c in suffix.items()},
        }
    )


def suffix_rates(labelled: DataFrame) -> DataFrame:
    """kind, suffix, rate. labelled: the suffixes, n (how often a URL is labelled) and blocked (how often for block)."""
    long = labelled.select("n", "blocked", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"s_{k}").alias("suffix")) for k in SUFFIXES])).alias("s"))
    return long.groupBy("s.kind", "s.suffix").agg(((F.sum("blocked") + PRIOR / 2) / (F.sum("n") + PRIOR)).alias("rate"))


def with_rates(urls: DataFrame, rates: DataFrame) -> DataFrame:
    for k in SUFFIXES:
        own = rates.where(F.col("kind") == k).select(F.col("suffix").alias(f"s_{k}"), F.col("rate").alias(f"f_{k}_rate"))
        urls = urls.join(sized(own), f"s_{k}", "left").fillna(0.5, [f"f_{k}_rate"])
    return urls


def fit(labelled: DataFrame, scratch: Scratch, max_train: int = 10_000, trees: int = 12, depth: int = 3):
    """(model, rates), or (the only verdict, None). labelled: columns url, host, path, label (1.0: block)."""
    distinct = labelled.groupBy("url", "host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked"))
    distinct = scratch.save(distinct, "distinct")
    of = {0.0: F.col("n") - F.col("blocked"), 1.0: F.col("blocked")}  # how often a URL has each label
    sizes = {label: distinct.where(n > 0).count() for label, n in of.items()}
    if not all(sizes.values()):
        return ("block" if sizes[1.0] else "allow"), None
    rates = scratch.save(suffix_rates(with_features(distinct)), "rates")
    half = max_train // 2
    taken = {label: min(sizes[label], max(half, max_train - sizes[1.0 - label])) for label in of}
    parts = [distinct.where(n > 0).orderBy(F.xxhash64("url"), "url").limit(taken[label]).withColumns({"label": F.lit(label), "share": n / F.col("n")}) for label, n in of.items()]
    sample = scratch.save(with_features(parts[0].union(parts[1])), "sample")
    total = {r["label"]: r["share"] for r in sample.groupBy("label").agg(F.sum("share").alias("share")).collect()}
    each = sum(total.values()) / 2.0
    weight = F.col("share") * F.when(F.col("label") == 1.0, F.lit(each / total[1.0])).otherwise(F.lit(each / total[0.0]))
    train = assembled(with_rates(sample, rates)).withColumn("weight", weight)
    return GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7).fit(train), rates


def assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=sorted(c for c in df.columns if c.startswith("f_")), outputCol="features").transform(df)


def judge(urls: DataFrame, model, rates) -> DataFrame:
    """Adds model_verdict to rows with url, host and path."""
    if rates is None:
        return urls.withColumn("model_verdict", F.lit(model))
    scored = model.transform(assembled(with_rates(with_features(urls), rates)))
    return scored.withColumn("model_verdict", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))


def filter_urls(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, labels: DataFrame | None = None, max_train: int = 10_000) -> DataFrame:
    """page_id, host, path, rule, verdict, by_rule. labels (url, label 1 for block): the labelled URLs; by default those that
    the rules decide."""
    host, path = host_and_path(F.col(url_col))
    urls = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": name, "ruled": verdict})
    if labels is None:
        known = urls.where(F.col("ruled").isNotNull()).select("url", "host", "path", (F.col("ruled") == "block").cast("double").alias("label"))
    else:
        h, p = host_and_path(F.col("url"))
        known = labels.select("url", h.alias("host"), p.alias("path"), F.col("label").cast("double").alias("label")).where(F.col("label").isNotNull())
    model, rates = fit(known, Scratch(df.sparkSession, "url-gbt"), max_train)
    return judge(urls, model, rates).select("page_id", "host", "path", "rule", F.coalesce("ruled", "model_verdict").alias("verdict"), F.col("ruled").isNotNull().alias("by_rule"))
