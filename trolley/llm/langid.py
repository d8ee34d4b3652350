"""Language identification: averaged embeddings of hashed subwords and a linear softmax,
trained by stochastic gradient descent in numpy, with calibrated rejection.

Training uses a bounded sample (``per_lang`` documents per language, one window of at most
``window`` characters each). Prediction reads every text whole. The averaged
embedding times the softmax weights is an average of one row per subword, so the model that
goes to the executors is one (buckets x languages) table, or, with more languages than
dimensions, the embeddings and the weights, which hardly grow with the languages."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trolley.plans.joins import checked_broadcast

from .common import bounded_batches, stage, table

GRAMS = (1, 2, 3, 4)


@dataclass
class Model:
    langs: list[str]
    rows: np.ndarray        # (buckets, langs): embedding times weights, over the temperature
    bias: np.ndarray
    threshold: float        # below this score a prediction is rejected
    weights: np.ndarray | None = None   # (dim, langs): if given, ``rows`` are the embeddings alone

    @property
    def parts(self) -> tuple:
        return self.langs, self.rows, self.bias, self.weights


def letter_table() -> np.ndarray:
    """Lower-case letter (or mark) of each BMP code point, 0 for everything else."""
    low = np.zeros(0x10000, dtype=np.uint32)
    for cp in range(0x10000):
        c = chr(cp)
        if unicodedata.category(c)[0] in "LM":
            low[cp] = ord(c.lower()) if len(c.lower()) == 1 else cp
    return low


def subwords(text: str, letters: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of all subwords: 1 to 4 characters of a word, with one mark for each word end.
    Empty if the text has no letter."""
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    c = np.zeros(len(cp) + 2, dtype=np.uint32)
    c[1:-1] = np.where(cp < 0x10000, letters[np.minimum(cp, 0xFFFF)], cp)
    for far in np.unique(cp[cp >= 0x10000]).tolist():       # beyond the table
        if unicodedata.category(chr(far))[0] not in "LM":
            c[1:-1][cp == far] = 0
    inside = c > 0
    out = []
    h = c * np.uint32(0x9E3779B1)
    ok = inside.copy()          # all characters between first and last are letters
    for n in GRAMS:
        if n > 1:
            if len(c) < n:
                break
            h = (h[:-1] * np.uint32(0x85EBCA6B)) ^ (c[n - 1:] * np.uint32(0xC2B2AE35) + np.uint32(n))
            ok = inside[:len(h)] | inside[1:len(h) + 1] if n == 2 else ok[:-1] & inside[n - 2:n - 2 + len(h)]
        x = h[ok]
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.append((x ^ (x >> np.uint32(13))) & np.uint32(buckets - 1))
        if n == 2:              # longer ones: inner characters are letters
            ok = np.ones(len(h), dtype=bool)
    return np.concatenate(out) if inside.any() else np.zeros(0, np.uint32)


def train(samples: list[tuple[str, str]], buckets: int = 1 << 16, dim: int = 16, epochs: int = 5, rate: float = 1.0,
          allowed: float = 0.002, seed: int = 11) -> Model | None:
    """Model of (text, lang) samples; None without a usable sample. One sample in five is kept
    for calibration: the temperature with the least log loss, and as threshold the highest
    score (at most one half) that rejects no more than ``allowed`` of its right predictions."""
    letters = letter_table()
    langs = sorted({lang for _, lang in samples})
    data = []
    for text, lang in samples:
        idx = subwords(text, letters, buckets)
        if len(idx):
            u, n = np.unique(idx, return_counts=True)
            data.append((u, (n / n.sum()).astype(np.float32)[:, None], langs.index(lang)))
    if not data:
        return None
    rng = np.random.default_rng(seed)
    data = [data[i] for i in rng.permutation(len(data))]
    check = data[::5] if len(data) >= 10 else data
    learn = [x for i, x in enumerate(data) if i % 5] if len(data) >= 10 else data
    emb = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    w, b = rng.normal(0, 0.1, (dim, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    steps, step = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            u, share, y = learn[i]
            lr, step = np.float32(rate * (1 - step / steps)), step + 1
            rows = emb[u]
            h = (rows * share).sum(0)
            z = h @ w + b
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y] -= 1
            back = w @ g
            w -= lr * np.outer(h, g)
            b -= lr * g
            emb[u] = rows - lr * share * len(u) ** 0.5 * back
    folded = len(langs) <= dim
    table_, head = (emb @ w, None) if folded else (emb, w)
    held = [(table_[u] * share).sum(0) for u, share, _ in check]
    logits = np.array([(x if folded else x @ head) + b for x in held])
    truth = np.array([y for *_, y in check])

    def probs(t: float) -> np.ndarray:
        z = logits / t
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    grid = np.geomspace(0.2, 20, 60)
    best = min(grid, key=lambda t: -np.log(probs(t)[np.arange(len(truth)), truth] + 1e-12).mean())
    p = probs(best)
    right = np.sort(p.max(1)[p.argmax(1) == truth])
    threshold = min(0.5, float(right[int(allowed * len(right))])) if len(right) else 0.0
    bias = (b / best).astype(np.float32)
    if folded:
        return Model(langs, (table_ / best).astype(np.float32), bias, threshold)
    return Model(langs, emb, bias, threshold, (w / best).astype(np.float32))


def predict(text: str | None, parts: tuple | None, letters: np.ndarray) -> tuple[str, float]:
    """Language and score of a text by (langs, rows, bias[, weights]) of a model."""
    if not text or not parts or not any(map(str.isalpha, text)):    # marks alone are no letters
        return "und", 0.0
    langs, rows, bias, *more = parts
    idx = subwords(text, letters, len(rows))
    if not len(idx):
        return "und", 0.0
    if len(idx) > len(rows):    # a very long text
        z = np.bincount(idx, minlength=len(rows)) @ rows.astype(np.float64) / len(idx)
    else:
        z = rows[idx].mean(0, dtype=np.float64)
    z = (z if not more or more[0] is None else z @ more[0]) + bias
    p = np.exp(z - z.max())
    k = int(p.argmax())
    return langs[k], float(p[k] / p.sum())


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 600,
        most_rows: int = 150_000, window: int = 1000, **options) -> Model | None:
    """Model fitted on at most ``per_lang`` rows (smallest seeded hash of ``key``) of each
    language, one window of ``window`` characters of each text. Beyond ``most_rows`` /
    ``per_lang`` languages each has fewer rows, one at least. Rows with a null language, key or
    text are not used."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    h = F.xxhash64(F.lit(5), F.col(key))
    counts = stage(rows.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n"), F.min(h).alias("least")), "languages")
    n_langs = counts.count()
    if not n_langs:
        return None
    per_lang = max(1, min(per_lang, most_rows // n_langs))
    start = F.pmod(F.xxhash64(F.lit(6), F.col(key)), F.greatest(F.length(text) - window, F.lit(0)) + 1).cast("int") + 1
    # more than per_lang rows by their hash's share, and the row of the least hash
    drawn = (F.pmod(h, F.lit(10**6)) < F.floor(F.lit(1.3 * 10**6 * per_lang) / F.col("n")) + 1) | (h == F.col("least"))
    sample = (rows.join(checked_broadcast(counts), F.col(lang) == F.col("l")).filter(drawn)
              .select("l", h.alias("h"), F.substring(F.col(text), start, F.lit(window)).alias("t"))
              .groupBy("l", "h").agg(F.min("t").alias("t"))     # rows that repeat a key count once
              .orderBy("h", "l", "t").limit(2 * per_lang * n_langs).collect())
    seen: dict[str, int] = {}
    samples = []
    for r in sample:
        seen[r["l"]] = seen.get(r["l"], 0) + 1
        if seen[r["l"]] <= per_lang:  # every third sample is short, for short texts
            samples.append((r["t"][:40 + abs(r["h"]) % 100] if seen[r["l"]] % 3 == 0 else r["t"], r["l"]))
    return train(samples, **options)


def language(text: Column, spark: SparkSession, model: Model | None) -> Column:
    """Struct (lang, score, rejected); ``und`` and 0 if the text is null or has no letter, or
    nothing was learned. Rejected: ``und``, or a score below the model's threshold."""
    bounded_batches(spark)
    # at most dim numbers a bucket and a language
    shared = spark.sparkContext.broadcast(model.parts if model else None)
    cut = model.threshold if model else 0.0

    @F.pandas_udf("lang string, score double, rejected boolean")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parts, letters = shared.value, letter_table()
        for texts in batches:
            found = pd.DataFrame([predict(t, parts, letters) for t in texts], columns=["lang", "score"])
            yield found.assign(rejected=(found["lang"] == "und") | (found["score"] < cut))
    return identify.asNondeterministic()(text)   # else a filter on the result runs it once more


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of these names are replaced. Row
    for row; repeated rows stay; empty tables stay empty."""
    found = docs.withColumn("_id", language(F.col(text), docs.sparkSession, model))
    return found.withColumns({"lang_pred": F.col("_id.lang"), "score": F.col("_id.score"), "rejected": F.col("_id.rejected")}).drop("_id")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    model = fit(docs.filter(fold(F.col("doc_id")) != 1))
    return (identify(docs.select("doc_id", "text", held.alias("held_out")), model)
            .select("doc_id", "held_out", "lang_pred", "score", "rejected"))
