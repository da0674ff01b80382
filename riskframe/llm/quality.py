"""Quality by hierarchical empirical Bayes: a document's own evidence and the record of its path and host.

A logistic classifier gives each document a probability from its text alone.
Summed over all documents these make the record of each path and host. A
path's rate is shrunk toward its host's and that toward the global rate, the
more the fewer documents it has; how much is estimated from the spread of the
rates themselves. The final odds are the document's evidence times the odds of
its path, from which the document itself has been taken out.

The classifier is fitted on at most ``SAMPLE`` labelled documents, taken in
the order of a hash of their ids; every other figure covers all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import fresh, utf8, with_columns
from riskframe.session import materialise

SAMPLE = 20_000
#: Site tables up to so many rows are broadcast; larger ones are joined by shuffle.
SITES = 100_000
FEATURES = 11
_SYMBOLS, _PIPES = b"#$%&*<>{}[]@^~=_\\+", b"|"
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_EDGE = 1e-6


def features(raw: bytes | None) -> list[float]:
    """What marks poor text: symbols, capitals, tables, repetition, and its lengths. Nothing to read: all zero."""
    words = (raw or b"").split()
    n, size = len(words), len(raw or b"")
    if not n:
        return [0.0] * FEATURES
    lines = [s for line in raw.split(b"\n") if (s := line.strip())]
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    return [
        1.0,
        np.log1p(n),
        min(size / n, 30.0),
        np.sqrt(share(_SYMBOLS)),
        np.sqrt(share(_PIPES)),
        np.sqrt(share(b"!")),
        np.sqrt(share(_UPPER)),
        np.sqrt(share(_DIGITS)),
        np.sqrt(again),
        np.log(len(set(words))) / np.log(n) if n > 1 else 1.0,
        len(set(lines)) / len(lines),
    ]


@dataclass(frozen=True)
class Classifier:
    """Logistic weights on standardised features; ``rate`` is the share of good documents it was fitted on."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    rate: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log-odds that the text adds to the rate; 0 where there is nothing to read."""
        z = ((x - self.mean) / self.scale) @ self.weights
        return np.where(x[:, 0] > 0, np.clip(z - _logit(self.rate), -12, 12), 0.0)


def _logit(p):
    p = np.clip(p, _EDGE, 1 - _EDGE)
    return np.log(p / (1 - p))


def fit_rows(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> Classifier:
    """Penalised logistic regression by Newton steps. Without rows of both kinds the evidence is 0 for all."""
    rate = float(np.clip(y.mean(), _EDGE, 1 - _EDGE)) if len(y) else 0.5
    mean, scale = np.zeros(FEATURES), np.ones(FEATURES)
    weights = np.zeros(FEATURES)
    weights[0] = _logit(rate)
    if len(np.unique(y)) < 2:
        return Classifier(weights, mean, scale, rate)
    mean[1:] = x[:, 1:].mean(axis=0)
    scale[1:] = np.maximum(x[:, 1:].std(axis=0), 1e-9)
    z = (x - mean) / scale
    ridge = np.eye(FEATURES) * penalty
    ridge[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge
        step = np.linalg.solve(hessian, z.T @ (y - p) - ridge @ weights)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(weights, mean, scale, rate)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Classifier:
    """The classifier of at most ``sample`` labelled documents; labels that are null are passed over."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id_"), F.col(label).cast("double").alias("y_"))
    taken = known.orderBy(F.xxhash64("id_"), "id_", "y_").limit(sample)
    texts = docs.select(F.col(id_col).alias("id_"), F.col(text).cast("string").alias("text_")).join(F.broadcast(taken), "id_")
    rows = with_columns(texts, ["text_"], [T.StructField("x_", T.ArrayType(T.DoubleType()))], _features).select("id_", "x_", "y_").collect()
    rows = sorted((r for r in rows if r.x_[0] > 0), key=lambda r: (r.id_, r.x_))
    return fit_rows(np.array([r.x_ for r in rows]).reshape(-1, FEATURES), np.array([r.y_ for r in rows]))


def _features(column: pa.Array) -> list[pa.Array]:
    return [pa.array([features(t) for t in utf8(column)], pa.list_(pa.float64()))]


def scored(docs: DataFrame, model: Classifier, name: str, text: str = "text") -> DataFrame:
    """``docs`` with the log-odds of each text."""

    def run(column: pa.Array) -> list[pa.Array]:
        x = np.array([features(t) for t in utf8(column)]).reshape(-1, FEATURES)
        return [pa.array(model.evidence(x))]

    return with_columns(docs, [text], [T.StructField(name, T.DoubleType())], run)


@dataclass(frozen=True)
class Prior:
    """Global rate, and how many documents' worth a host's and a path's prior weigh."""

    rate: float
    host: float
    path: float


def _strength(rate: float, spread: float | None, groups: int, n: float) -> float:
    """Weight of a prior of mean ``rate`` if group rates vary by ``spread`` around it (moments of a beta)."""
    if groups < 2 or not n:
        return 1.0
    variance = max(spread or 0.0, 1e-6)
    return float(np.clip(rate * (1 - rate) / variance - 1, 1.0, 1e4))


def sites(marks: DataFrame) -> tuple[DataFrame, Prior]:
    """Posterior sums of each (host, path) of ``marks`` (host, path, p), and the prior estimated from them."""
    paths = marks.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * (1 - F.col("p"))).alias("w"))
    paths = materialise(paths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("w").alias("host_w"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    if not total.n:
        return paths.join(hosts, "host"), Prior(0.5, 1.0, 1.0)
    rate = float(np.clip(total.s / total.n, _EDGE, 1 - _EDGE))

    def between(mean: Column, s: Column, n: Column, w: Column) -> Column:
        """Squared distance of a group's rate from ``mean`` beyond what its size explains, weighed by its size."""
        return F.sum(n * (F.pow(s / n - mean, 2) - w / (n * n))) / F.sum(n)

    c = F.col
    of_hosts = hosts.agg(between(F.lit(rate), c("host_s"), c("host_n"), c("host_w")).alias("v"), F.count(F.lit(1)).alias("k")).first()
    both = paths.join(hosts, "host")
    of_paths = both.agg(between(c("host_s") / c("host_n"), c("s"), c("n"), c("w")).alias("v"), F.count(F.lit(1)).alias("k")).first()
    return both, Prior(rate, _strength(rate, of_hosts.v, of_hosts.k, total.n), _strength(rate, of_paths.v, of_paths.k, total.n))


def judged(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, label: str = "quality", text: str = "text", id_col: str = "doc_id",
    threshold: float = 0.5, sample: int = SAMPLE,
) -> DataFrame:
    """``docs`` with host, path, p_doc, host_rate, path_rate, p_quality and keep.

    ``host_rate`` and ``path_rate`` are posterior means. A null host or path
    counts as "". Texts that are null or blank add no evidence: their path
    decides. Without labels of both kinds nothing adds evidence and everything
    is judged by a rate of a half or the labels' own; an empty table gives an
    empty result. Repeated rows count as often as they occur.
    """
    model = fit(docs, labels, label, text, id_col, sample)
    host_c, path_c, p_c, host_r, path_r, final, keep, z = fresh(docs, "host", "path", "p_doc", "host_rate", "path_rate", "p_quality", "keep", "z_")
    named = docs.withColumns({host_c: F.coalesce(host.cast("string"), F.lit("")), path_c: F.coalesce(path.cast("string"), F.lit(""))})
    lift = float(_logit(model.rate))
    chance = lambda odds: 1 / (1 + F.exp(-odds))
    marks = scored(named.select(host_c, path_c, text), model, z, text)
    marks = marks.select(F.col(host_c).alias("host"), F.col(path_c).alias("path"), chance(F.col(z) + lift).alias("p"))
    record, prior = sites(marks)
    record = record.select(F.col("host").alias(host_c), F.col("path").alias(path_c), "n", "s", "host_n", "host_s")
    own = ["n", "s", "host_n", "host_s"]
    renamed = fresh(named, *(f"{c}_" for c in own))
    record = record.withColumnsRenamed(dict(zip(own, renamed)))
    if record.count() <= SITES:
        record = F.broadcast(record)
    n, s, hn, hs = (F.col(c) for c in renamed)
    p = F.col(p_c)
    site = lambda less: (
        (F.lit(prior.path) * (F.lit(prior.host * prior.rate) + hs - less) / (prior.host + hn - (less > 0).cast("int")) + s - less)
        / (prior.path + n - (less > 0).cast("int"))
    )
    odds = lambda q: F.log(F.greatest(q, F.lit(_EDGE)) / F.greatest(1 - q, F.lit(_EDGE)))
    out = scored(named, model, z, text).withColumn(p_c, chance(F.col(z) + lift)).join(record, [host_c, path_c])
    out = out.withColumns({host_r: (prior.host * prior.rate + hs) / (prior.host + hn), path_r: site(F.lit(0.0))})
    out = out.withColumn(final, chance(F.col(z) + odds(site(p)))).withColumn(keep, F.col(final) >= threshold)
    return out.select(*docs.columns, host_c, path_c, p_c, host_r, path_r, final, keep)
