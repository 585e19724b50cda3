"""URL filters: rules first, then gradient-boosted trees on lexical features.

Rules are (host, path) pairs with a verdict. They fit their host, all its
subdomains, and paths that start with theirs; the longest wins. Every other url
is judged by boosted trees, trained from labelled urls on lexical features:
length, depth, digit ratio, entropy, parameter counts and statistics of the
host's suffix. All of it is DataFrame functions and Spark's own tree ensemble;
the url is parsed and judged within its row.

Training takes at most about ``sample`` distinct labelled urls (a documented
bound; chosen by hash). With no labelled urls or with one kind only there is
nothing to learn: the verdict is then that kind, or allow. Null urls and urls
without ``://`` have an empty host and path, and features of an empty url;
they are judged by the method like others. Repeated rows are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import scratch

#: (verdict, host, path) of the production rules. Fixed values.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Most distinct labelled urls that the trees are trained from, about.
SAMPLE = 20_000
#: Folds of the training urls' suffix statistics.
FOLDS = 5
#: Most rules that are judged within the row.
MOST_RULES = 500
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "dash_count", "entropy", "parameters", "fragment", "suffix_rate", "suffix_weight"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` with A-Z lower-cased; path up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules are judged within a row")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text)
    seen = F.array_distinct(F.split(text, ""))
    total = F.aggregate(seen, F.lit(0.0), lambda a, c: a + (n - F.length(F.replace(text, c, F.lit("")))) * F.log2((n - F.length(F.replace(text, c, F.lit("")))).cast("double")))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)


def lexical(df: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """``df`` with the features that need no statistics, and ``suffix``, the host's last label."""
    u = F.coalesce(F.col(url), F.lit(""))
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    digits = F.length(u) - F.length(F.translate(u, "0123456789", ""))
    return df.withColumns({
        "length": F.length(u), "host_length": F.length(host), "path_length": F.length(path), "depth": count(F.col(path), "/"), "labels": count(F.col(host), "."),
        "digit_ratio": digits / F.greatest(F.length(u), F.lit(1)), "dash_count": count(F.col(host), "-"), "entropy": entropy(u),
        "parameters": count(u, "="), "fragment": count(u, "#"), "suffix": F.substring_index(F.col(host), ".", -1),
    })


@dataclass
class UrlModel:
    """Trees and suffix statistics; ``trees`` is None if only ``constant`` was seen."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame  # suffix, suffix_rate, suffix_weight: one row per suffix of the sample
    prior: float
    constant: str


def _with_suffixes(df: DataFrame, suffixes: DataFrame, prior: float) -> DataFrame:
    out = df.join(F.broadcast(suffixes), "suffix", "left")  # at most one row for each url of the bounded sample
    return out.withColumns({"suffix_rate": F.coalesce("suffix_rate", F.lit(prior)), "suffix_weight": F.coalesce("suffix_weight", F.lit(0.0))})


def train(labelled: DataFrame, url: str = "url", label: str = "blocked", sample: int = SAMPLE, trees: int = 20, depth: int = 4) -> UrlModel:
    """Fit on rows with a url and a label (1: block, 0: allow); rows with null in either are left out.

    A url with several labels takes the larger.
    """
    rows = labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label")).where("url is not null and label is not null")
    rows = scratch.table(rows.groupBy("url").agg(F.max("label").alias("label")), "labelled")
    n = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("bad")).first()
    share = min(1.0, sample / max(1, n["n"]))
    some = rows.where(F.xxhash64("url") < F.lit(min(int(share * 2**64) - 2**63, 2**63 - 1)))  # a 64-bit threshold, whatever n is
    host, path = parse(F.col("url"))
    some = scratch.table(lexical(some.withColumns({"host": host, "path": path}), "url", "host", "path").coalesce(4), "features")
    prior = n["bad"] / n["n"] if n["n"] else 0.0
    weight = F.count("*").cast("double")
    rate = lambda bad, n: (bad + 4 * prior) / (n + 4)
    suffixes = some.groupBy("suffix").agg(rate(F.sum("label"), weight).alias("suffix_rate"), F.log1p(weight).alias("suffix_weight"))
    suffixes = scratch.table(suffixes, "suffixes")
    kinds = some.select("label").distinct().count()
    if kinds < 2:
        return UrlModel(None, suffixes, prior, "block" if prior > 0.5 else "allow")
    # a training url's suffix rate leaves out the urls of its own fold, or its label would leak into its features
    some = some.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS)))
    parts = some.groupBy("suffix", "fold").agg(F.sum("label").alias("bad"), weight.alias("n"))
    whole = parts.groupBy("suffix").agg(F.sum("bad").alias("all_bad"), F.sum("n").alias("all_n"))
    others = parts.join(whole, "suffix").select("suffix", "fold", rate(F.col("all_bad") - F.col("bad"), F.col("all_n") - F.col("n")).alias("suffix_rate"), F.log1p(F.col("all_n") - F.col("n")).alias("suffix_weight"))
    table = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(some.join(others, ["suffix", "fold"])).select("vector", "label")
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, subsamplingRate=0.8, seed=7).fit(table)
    return UrlModel(model, suffixes, prior, "")


def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]] = RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep``, host, path, rule, verdict (the rule's, else the trees'), score (the trees' probability of block)."""
    host, path = parse(F.col("url"))
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(url).alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    if model.trees is None:
        score = F.lit(1.0 if model.constant == "block" else 0.0)
    else:
        rows = _with_suffixes(lexical(rows, "url", "host", "path"), model.suffixes, model.prior)
        rows = model.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(rows))
        score = vector_to_array("probability")[1]
    rows = rows.withColumn("score", score)
    own = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return rows.select("row.*", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")


def labelled_by_rules(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """(url, blocked): the urls that a rule judges, labelled by it.

    For tables without labels of their own. What the trees can learn from these
    is how blocked and allowed urls look, not the rules: paths are known to them
    by length, depth and digits only.
    """
    host, path = parse(F.col("url"))
    rows = pages.select(F.col(url).alias("url")).withColumns({"host": host, "path": path})
    return rows.select("url", (rule_of(F.col("host"), F.col("path"), rules)[1] == "block").cast("int").alias("blocked")).where("blocked is not null")
