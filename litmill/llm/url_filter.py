"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for the rest (native)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.llm.common import LOWER, UPPER, table
from litmill.session import cut_lineage

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
TRAIN_ROWS = 100_000
TREES, DEPTH, STEP, SEED = 20, 4, 0.2, 7
PRIOR = 20.0


def host_and_path(url: Column) -> dict[str, Column]:
    """host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end.

    Both are empty for null and for a text without `://`.
    """
    url = F.coalesce(url, F.lit(""))
    parts = r"://([^/?#]*)([^?#]*)"
    return {"host": F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER), "path": F.regexp_extract(url, parts, 2)}


def matched(rules: Sequence[tuple[str, str]], value: int) -> Column:
    """Field ``value`` (0: verdict, 1: rule) of the longest of ``rules`` that fits host and path, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = rule[1].partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(slash + path))
        out = F.when(fits, F.lit(rule[value])).otherwise(out)
    return out


def lexical(url: Column) -> dict[str, Column]:
    """Features of the URL's text; host and path are columns already."""
    u = F.coalesce(url, F.lit(""))
    size = F.greatest(F.char_length(u), F.lit(1))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    chars = F.array_distinct(F.split(u, ""))
    share = F.transform(chars, lambda c: (F.char_length(u) - F.char_length(F.replace(u, c, F.lit("")))) / size)
    entropy = F.aggregate(share, F.lit(0.0), lambda a, p: F.when(p > 0, a - p * F.log2(p)).otherwise(a))
    count = lambda x, pattern: F.regexp_count(x, F.lit(pattern))
    return {
        "f_length": F.char_length(u),
        "f_host_length": F.char_length("host"),
        "f_path_length": F.char_length("path"),
        "f_depth": count(F.col("path"), "/+[^/]"),
        "f_labels": count(F.col("host"), r"[^.]+"),
        "f_digits": count(u, "[0-9]") / size,
        "f_path_digits": count(F.col("path"), "[0-9]"),
        "f_signs": count(u, "[^A-Za-z0-9]") / size,
        "f_entropy": entropy,
        "f_parameters": F.when(query == "", 0).otherwise(1 + count(query, "[&;]")),
        "f_fragment": F.contains(u, F.lit("#")).cast("int"),
        "f_secure": F.startswith(u, F.lit("https:")).cast("int"),
        "f_closed": F.endswith(F.col("path"), F.lit("/")).cast("int"),
    }


SUFFIXES = {"top": r"([^.]*)$", "site": r"([^.]*\.[^.]*)$", "ending": r"\.([A-Za-z0-9]{1,8})$"}


def featured(urls: DataFrame, label: Column) -> tuple[DataFrame, list[str]]:
    """(rows with features and ``label``, feature names). Statistics of each suffix come from all rows of ``urls``.

    For a labelled row its own label is left out of the suffix's rate, or the rate would tell the label. Suffix tables have a
    row per suffix; a suffix that holds most URLs is a hot key on one side only, which Spark's skew join splits.
    """
    rows = urls.withColumns(lexical(F.col("url"))).withColumn("label", label)
    names = [c for c in rows.columns if c.startswith("f_")]
    for kind, pattern in SUFFIXES.items():
        rows = rows.withColumn(f"s_{kind}", F.regexp_extract("path" if kind == "ending" else "host", pattern, 1))
    rows = cut_lineage(rows)
    all_ = rows.agg(F.count("*"), F.count("label"), F.sum("label")).first()
    prior = (float(all_[2] or 0) + 1) / (float(all_[1]) + 2)
    for kind in SUFFIXES:
        key = f"s_{kind}"
        stats = rows.groupBy(key).agg(F.count("*").alias("_n"), F.count("label").alias("_l"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("_b"))
        own = F.coalesce(F.col("label"), F.lit(0.0))
        known = F.col("_l") - F.col("label").isNotNull().cast("int")
        rate = (F.col("_b") - own + PRIOR * prior) / (known + PRIOR)
        rows = rows.join(stats, key).withColumns({f"f_{kind}_rate": rate, f"f_{kind}_share": F.col("_n") / float(all_[0] or 1)}).drop("_n", "_l", "_b")
        names += [f"f_{kind}_rate", f"f_{kind}_share"]
    return rows, names


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row of ``pages`` (page_id, url; others are ignored).

    The longest rule that fits host (with its subdomains) and start of path gives the verdict and, as its string, ``rule``.
    Other URLs are judged by boosted trees that learn from the URLs with a rule: from all of them, or from those with the
    smallest hashes, about ``train_rows``, where there are more. score: the trees' probability of block. If the rules label
    nothing, or all alike, that label (allow if there is none) is the verdict and the score is null. Null and empty URLs have
    an empty host and path and go to the trees. Rows that repeat come back as often. An empty table gives no rows.
    """
    urls = pages.select("page_id", "url").withColumns(host_and_path(F.col("url")))
    urls = urls.withColumns({"rule": matched(rules, 1), "by_rule": matched(rules, 0)})
    label = F.when(F.col("by_rule") == "block", 1.0).when(F.col("by_rule") == "allow", 0.0)
    rows, names = featured(urls, label)
    rows = cut_lineage(VectorAssembler(inputCols=names, outputCol="features").transform(rows.withColumns({n: F.col(n).cast("double") for n in names})))
    known = {r["label"]: r["n"] for r in rows.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    out = ["page_id", "host", "path", "rule"]
    if len(known) < 2:
        only = "block" if 1.0 in known else "allow"
        return rows.select(*out, F.coalesce("by_rule", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    share = min(1.0, train_rows / sum(known.values()))
    chosen = F.pmod(F.xxhash64("url", "page_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    train = cut_lineage(rows.where("label is not null").where(chosen | F.lit(share == 1.0)).select("features", "label"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, checkpointInterval=-1).fit(train)
    judged = trees.transform(rows)
    verdict = F.coalesce("by_rule", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))
    return judged.select(*out, verdict.alias("verdict"), vector_to_array("probability")[1].alias("score"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages", "page_id", "url"))
