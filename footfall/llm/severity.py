"""Toxicity: ordinal regression of severity grades on sparse words.

A cumulative-link (proportional odds) model: P(grade <= k) is the logistic of
threshold_k - w.x, with one weight vector for all thresholds, which stay in
order. It is fitted on a bounded sample of labelled documents and applied to
every document in its tasks; the model has at most the words of that sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.ngram_join import shingle_set
from footfall.llm.text import unused_names
from footfall.ship import ship

#: Most labelled documents the model is fitted on.
SAMPLE_ROWS = 8000
#: Odd factors of the minhashes that tell near copies in the sample, and how many of them must agree.
SKETCH = np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
SAME = 48

#: ASCII letters and digits in lower case, all other ASCII as blanks.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

SCORES = "expected_severity double, severity_grade int, p_toxic double, toxic boolean"


def words(text: str | None) -> set[bytes]:
    return set((text or "").encode().translate(_FOLD).split())


def feature(word: bytes) -> int:
    """A 63-bit hash of a word."""
    return xxhash.xxh64_intdigest(word) >> 1


@dataclass
class OrdinalModel:
    weights: dict[int, float]  # by feature; as many as the sample bears out
    thresholds: np.ndarray  # ascending, one fewer than there are grades

    def score(self, x: float) -> tuple[float, int, float]:
        """Expected grade, likeliest grade and chance of a grade above 0."""
        above = 1 / (1 + np.exp(np.clip(self.thresholds - x, -60, 60)))
        chance = -np.diff(np.r_[1.0, above, 0.0])
        return float(above.sum()), int(chance.argmax()), float(above[0])


def telling_features(docs: list[np.ndarray], toxic: np.ndarray, least: int = 5, chi2: float = 15.0) -> np.ndarray:
    """Features tied to the labels beyond chance."""
    names, at = np.unique(np.concatenate(docs), return_inverse=True)
    is_toxic = np.repeat(toxic, [len(d) for d in docs])
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    a = np.bincount(at[is_toxic], minlength=len(names))
    b = np.bincount(at[~is_toxic], minlength=len(names))
    seen = a + b
    expected = seen * n1 / (n1 + n0)
    spread = np.maximum(1e-9, expected * n0 / (n1 + n0))
    chosen = (seen >= least) & ((a - expected) ** 2 / spread >= chi2)
    return names[chosen]


def fit(docs: list[np.ndarray], grades: np.ndarray, chosen: np.ndarray, l2: float = 0.3, steps: int = 400) -> OrdinalModel:
    """Maximum likelihood with a ridge penalty, by Adam over the whole sample."""
    top = max(1, int(grades.max(initial=1)))
    own = [d[np.isin(d, chosen)] for d in docs]
    row = np.repeat(np.arange(len(own)), [len(o) for o in own])
    col = np.concatenate(own) if own else np.zeros(0, np.int64)
    used, col = np.unique(col, return_inverse=True)
    # the first threshold and the logarithms of the gaps keep thresholds in order
    params = np.concatenate([np.zeros(len(used)), [1.0], np.zeros(top - 1)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    n, k = len(own), len(used)
    lo, hi = grades - 1, np.minimum(grades, top - 1)
    for step in range(1, steps + 1):
        w, gaps = params[:k], np.exp(params[k + 1 :])
        theta = params[k] + np.r_[0.0, np.cumsum(gaps)]
        x = np.bincount(row, w[col], n)
        up = np.where(grades < top, 1 / (1 + np.exp(np.clip(x - theta[hi], -30, 30))), 1.0)
        down = np.where(grades > 0, 1 / (1 + np.exp(np.clip(x - theta[np.maximum(lo, 0)], -30, 30))), 0.0)
        p = np.maximum(up - down, 1e-12)
        du, dd = up * (1 - up) / p, down * (1 - down) / p
        g_theta = np.bincount(hi, np.where(grades < top, -du, 0.0), top) + np.bincount(
            np.maximum(lo, 0), np.where(grades > 0, dd, 0.0), top
        )
        g_w = np.bincount(col, (du - dd)[row], k) / n + l2 * w / n
        tails = np.cumsum(g_theta[::-1])[::-1] / n
        grad = np.concatenate([g_w, tails[:1], tails[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(dict(zip(used.tolist(), params[:k].tolist())), params[k] + np.r_[0.0, np.cumsum(np.exp(params[k + 1 :]))])


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> pd.DataFrame:
    """Up to ``sample_rows`` labelled documents as distinct features, by hash of doc_id.

    Of near copies among them one stays: documents of which SAME of the minhashes
    of their 5-word shingles agree, so a similarity of 0.75 or so. Documents that
    share less are all kept. Labels without grades have two levels of their own:
    toxic documents of good quality are graded 1, those of bad quality 2.
    """

    @F.pandas_udf("array<long>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({feature(w) for w in words(t)}) for t in texts], dtype=object)

    @F.pandas_udf("array<long>")
    def sketch(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            s = shingle_set(t)
            out.append([int((s * odd).min() >> np.uint64(1)) for odd in SKETCH] if len(s) else [])
        return pd.Series(out, dtype=object)

    if "grade" in labels.columns:
        graded = F.col("grade").cast("int")
    elif "quality" in labels.columns:
        graded = F.when(F.col("quality") == 0, 2).otherwise(1)
    else:
        graded = F.lit(1)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = (
        known.groupBy("doc_id")
        .agg(F.max(F.struct("toxic", graded.alias("grade"))).alias("l"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
        .select("doc_id", F.col("l.toxic").alias("toxic"), F.col("l.grade").alias("grade"))
    )
    # at most sample_rows short rows, so the broadcast is bounded
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "toxic", "grade", features("text").alias("f"), sketch("text").alias("sketch")
    )
    sample = rows.orderBy("doc_id", "sketch").limit(sample_rows).toPandas()
    # near copies would make their chance words look like marks of their label
    holders: dict = {}
    kept: list[np.ndarray] = []
    own = []
    for row in sample["sketch"]:
        row = np.asarray(row)
        marks = list(enumerate(row.tolist()))
        near = {k for m in marks for k in holders.get(m, ())}
        own.append(not any((kept[k] == row).sum() >= SAME for k in near))
        if own[-1] and marks:
            for m in marks:
                holders.setdefault(m, []).append(len(kept))
            kept.append(row)
    return sample[np.array(own, bool)]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit the model on at most ``sample_rows`` labelled documents.

    ``labels`` has doc_id, toxic and maybe grade (0 for clean, else from 1); see
    :func:`labelled_sample` for labels without grades. Labels that are null or
    whose document is missing are left out; with none left the model says clean.
    """
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, sample_rows)
    own = [np.asarray(f, np.int64) for f in sample["f"]]
    toxic = sample["toxic"].to_numpy(float) > 0
    if not toxic.any():
        return OrdinalModel({}, np.array([5.0]))
    given = np.nan_to_num(pd.to_numeric(sample["grade"]).to_numpy(float), nan=1.0)
    grades = np.where(toxic, np.maximum(1, given), 0).astype(int)
    return fit(own, grades, telling_features(own, toxic))


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` with SCORES of its text in added columns.

    A text scores the sum of the weights of its distinct words. Null or empty
    text has none. Rows are scored one by one, whatever their doc_id.
    """
    ship(docs.sparkSession)

    @F.pandas_udf(SCORES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, float] = {}
        for texts in batches:
            out = []
            for text in texts:
                if len(known) > 400_000:
                    known.clear()
                own = words(text)
                for w in [w for w in own if w not in known]:
                    known[w] = model.weights.get(feature(w), 0.0)
                x = sum(sorted(filter(None, map(known.__getitem__, own))))
                expected, grade, p = model.score(x)
                out.append((expected, grade, p, p >= 0.5))
            yield pd.DataFrame(out, columns=["expected_severity", "severity_grade", "p_toxic", "toxic"])

    added = ["expected_severity", "severity_grade", "p_toxic", "toxic"]
    extra = [c for c in docs.columns if c not in added]
    (scores,) = unused_names(docs, "scores")
    return docs.select(*extra, run("text").alias(scores)).select(*extra, f"{scores}.*")


def op6_ordinal_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Severity of every document by a model fitted on ``labels``."""
    return score(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
