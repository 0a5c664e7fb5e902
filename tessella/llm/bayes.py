"""Quality classifier with hierarchical empirical Bayes.

A logistic regression on the counted signals of a text, fitted on a bounded sample of the labelled rows, gives each
document its own evidence. Sites are judged by grouped aggregation: each host, and each path of a host, has the sum of
its documents' evidence (the label where there is one, else the classifier's probability). A host's rate is shrunk
towards the global rate and a path's towards its host's, with as much prior weight as the spread between sites calls
for (method of moments), so that sparse sites say little. A document is left out of the sums by which it is judged: its own
evidence counts once. The posterior log odds of a document are its own plus those of its path over the global ones.

Host and path are any two columns. The table documents has no URL, so op10 takes the source as the host and the language as
the section of it that stands for a path; classify_pages() has real ones, those of the pages' URLs.

Evidence is added up as whole billionths, so sums don't depend on the order of rows.

Nulls: a null text has no words, a null host or path is a site of its own, rows without a quality are not labelled; a
doc_id with several labels is good only if all of them say so. Rows that repeat a doc_id each get their row and count each.
Ties don't arise: nothing is ranked. Very long texts are counted whole. With fewer than LEAST labels, or of one kind, the
classifier is the prior. An empty table gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored
from .rules import features, signals

#: Labelled rows that the classifier is fitted on at most, chosen by a hash of doc_id.
FITTED = 200_000
LEAST = 20
#: Bounds of the prior's weight in documents.
WEIGHT_LEAST, WEIGHT_MOST = 5.0, 10_000.0
#: Posterior from which a document is kept.
KEEP = 0.5


def inputs() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return signals() | {
        "short": (F.col("n_words") < 20).cast("double"),
        "log_words": F.log1p(F.col("n_words")),
        "word_length": F.least(F.lit(20.0), chars / words),
    }


def _columns() -> list[Column]:
    return [x.cast("double").alias(n) for n, x in inputs().items()]


def fit(feats: DataFrame, labels: DataFrame, most: int = FITTED) -> tuple[float, dict[str, float], float]:
    """Intercept and coefficients of the log odds of being good, and the share of good labels."""
    quality = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("good"))
    known = feats.join(quality, "doc_id").select("doc_id", F.col("good").cast("double").alias("good"), *_columns())
    n, good = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("good"), F.lit(0.0))).first()
    rate = (good + 1) / (n + 2)
    if n < LEAST or good in (0, n):
        return math.log(rate / (1 - rate)), {}, rate
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * most / n))
    known = stored(known, "fitted")
    ready = VectorAssembler(inputCols=list(inputs()), outputCol="x").transform(known).select("x", "good")
    model = LogisticRegression(featuresCol="x", labelCol="good", maxIter=30, regParam=1e-4).fit(ready)
    return float(model.intercept), dict(zip(inputs(), map(float, model.coefficients), strict=True)), rate


def _odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(p / (1 - p))


#: Of a sum of evidence.
UNIT = 1_000_000_000


def url_site(url: Column) -> tuple[Column, Column]:
    """Host of a URL (lower case, without user and port) and the first step of its path ('' if it has none)."""
    rest = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    ends = F.split(F.regexp_replace(rest, "[?#].*$", ""), "/")
    host = F.lower(F.regexp_replace(F.regexp_replace(ends[0], "^.*@", ""), ":[0-9]*$", ""))
    return host, F.coalesce(F.get(ends, F.lit(1)), F.lit(""))


def _named(rows: DataFrame, id_: Column, text: Column, host: Column, path: Column) -> DataFrame:
    """Features of rows with their site."""
    site = lambda c, n: F.coalesce(c.cast("string"), F.lit(NULL)).alias(n)
    narrow = rows.select(id_.cast("long").alias("doc_id"), text.alias("text"), F.lit("").alias("lang"), site(host, "host"), site(path, "path"))
    return stored(features(narrow, {"host": F.col("host"), "path": F.col("path")}), "features")


def _odds_of(model: tuple[float, dict[str, float], float]) -> Column:
    """Log odds of a text by its features."""
    intercept, weights, _ = model
    odds = F.lit(intercept)
    for name, x in inputs().items():
        if name in weights:
            odds = odds + weights[name] * x.cast("double")
    return odds


def _units(p: Column) -> Column:
    return F.round(p * UNIT).cast("long")


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """(doc_id, host, path, doc_prob, host_rate, path_rate, posterior, kept) for every row of docs. Rates are those without
    the document itself."""
    feats = _named(docs, F.col("doc_id"), F.col("text"), F.col("source") if host is None else host, F.col("lang") if path is None else path)
    quality = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("good"))
    judged = feats.select("doc_id", "host", "path", _odds_of(fit(feats, labels)).alias("own")).join(quality, "doc_id", "left")
    return combined(stored(judged.withColumn("e", _units(F.coalesce("good", 1 / (1 + F.exp(-F.col("own")))))).drop("good"), "evidence"))


def classify_pages(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The same for pages (page_id, url, text), as doc_id their page_id: the classifier is fitted on the labelled documents, and
    the hosts and paths are those of the URLs. A null URL is a site of its own."""
    model = fit(_named(docs, F.col("doc_id"), F.col("text"), F.lit(None), F.lit(None)), labels)
    host, path = url_site(F.col("url"))
    feats = _named(pages, F.col("page_id"), F.col("text"), host, path)
    own = _odds_of(model)
    return combined(stored(feats.select("doc_id", "host", "path", own.alias("own"), _units(1 / (1 + F.exp(-own))).alias("e")), "evidence"))


#: Stands for a null host or path.
NULL = "\x00null"


def combined(probable: DataFrame) -> DataFrame:
    """The result of classify() from (doc_id, host, path, own, e): own log odds and evidence in units."""
    paths = stored(probable.groupBy("host", "path").agg(F.count(F.lit(1)).alias("m"), F.sum("e").alias("s")), "sites")
    hosts = stored(paths.groupBy("host").agg(F.sum("m").alias("m"), F.sum("s").alias("s")), "sites")
    total, good = hosts.agg(F.sum("m"), F.sum("s")).first()
    if not total:
        return probable.select("doc_id", "host", "path", *(F.lit(None).cast("double").alias(c) for c in ("doc_prob", "host_rate", "path_rate", "posterior")), F.lit(None).cast("boolean").alias("kept"))
    overall = good / UNIT / total
    host_weight = prior_weight(hosts.withColumn("prior", F.lit(overall)))
    rate = lambda s, m, w, prior: (s / UNIT + w * prior) / (m + w)
    known = hosts.withColumn("prior", rate(F.col("s"), F.col("m"), host_weight, F.lit(overall))).select("host", "prior", F.col("m").alias("host_m"), F.col("s").alias("host_s"))
    sites = stored(paths.join(known, "host"), "sites")
    path_weight = prior_weight(sites)
    # a site of many documents meets them where they lie
    out = probable.join(small(sites, sites.count()), ["host", "path"])
    host_rate = rate(F.col("host_s") - F.col("e"), F.col("host_m") - 1, host_weight, F.lit(overall))
    path_rate = rate(F.col("s") - F.col("e"), F.col("m") - 1, path_weight, host_rate)
    posterior = 1 / (1 + F.exp(-(F.col("own") + _odds(path_rate) - _odds(F.lit(overall)))))
    return out.select(
        "doc_id",
        F.nullif(F.col("host"), F.lit(NULL)).alias("host"),
        F.nullif(F.col("path"), F.lit(NULL)).alias("path"),
        F.round(1 / (1 + F.exp(-F.col("own"))), 6).alias("doc_prob"),
        F.round(host_rate, 6).alias("host_rate"),
        F.round(path_rate, 6).alias("path_rate"),
        F.round(posterior, 6).alias("posterior"),
        (posterior >= KEEP).alias("kept"),
    )


def prior_weight(sites: DataFrame) -> float:
    """The documents that the prior of sites (m documents, s units of evidence, prior) counts for, by the method of moments:
    few where sites lie further apart than chance makes them."""
    q, m = F.col("prior") * (1 - F.col("prior")), F.col("m")
    exact = lambda x: F.sum(F.round(x * UNIT).cast("decimal(38,0)"))
    spread, chance, within = (float(x or 0) for x in sites.agg(exact(m * F.pow(F.col("s") / UNIT / m - F.col("prior"), 2)), exact(q), exact(m * q)).first())
    return min(WEIGHT_MOST, max(WEIGHT_LEAST, within / (spread - chance) - 1)) if spread > chance else WEIGHT_MOST
