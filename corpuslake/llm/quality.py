"""Document quality by a factorisation machine.

Features of a text: its hashed tokens (words and runs of other signs) with damped
counts, and structure statistics and metadata (length, lines, letter, digit, upper-case and symbol shares, repetition) in
fixed slots. The score is the logistic of

    b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

whose last term is all pairwise interactions in time linear in the features. Weights
are fitted by Adam on at most ``sample`` labelled rows (chosen by the hash of their
id); the model has a fixed size. Scoring reads every whole text within its task.

Nulls and odd input: a null text is scored as the empty one, by the bias and the
statistics of an empty text. Labels of a doc_id that has several count with their mean; labels
without document teach nothing, and of texts that repeat a doc_id the smallest one is learned from. Without labels the score is 0.5. Rows that repeat are scored
alike. Other columns pass through; one with the name of a result column is replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_OTHER = re.compile(r"[\W\d_]+")
_STATS = 14


def _statistics(text: str, counts: Counter, tokens: int) -> list[float]:
    n = max(len(text), 1)
    raw = text.encode("utf-8", "replace")
    letters = len(_OTHER.sub("", text)) / n
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text)) / n
    digits = len(re.findall(r"\d", text)) / n
    spaces = text.count(" ") / n
    lines = text.split("\n")
    several = sum(c for c in counts.values() if c > 1) / max(tokens, 1)
    most = max(counts.values(), default=0) / max(tokens, 1)
    return [
        1.0, np.log1p(n) / 10, np.log1p(len(lines)) / 5, letters, upper * 3, digits * 5, spaces * 3,
        (1 - letters - digits - spaces) * 3, len(counts) / max(tokens, 1), several, most * 3,
        1 - len(set(lines)) / len(lines), text.count("|") / n * 20, (len(raw) - len(text)) / n * 3,
    ]


class Features:
    """Texts to (slots, values, lengths); slots below _STATS are statistics."""

    def __init__(self, bits: int):
        self.size, self.cache = 1 << bits, {}

    def _slot(self, token: str) -> int:
        slot = self.cache.get(token)
        if slot is None:
            if len(self.cache) >= 150_000:
                self.cache.clear()
            slot = self.cache[token] = _STATS + xxhash.xxh32_intdigest(token) % self.size
        return slot

    def of(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slots, values, lengths = [], [], []
        for text in texts:
            text = text or ""
            tokens = _TOKEN.findall(text)
            counts = Counter(tokens)
            damped = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
            damped /= max(float(np.sqrt((damped**2).sum())), 1e-6)
            slots.append(np.concatenate([np.arange(_STATS), np.fromiter(map(self._slot, counts), np.int64, len(counts))]))
            values.append(np.concatenate([np.array(_statistics(text, counts, len(tokens)), np.float32), damped]))
            lengths.append(_STATS + len(counts))
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        return join(slots, np.int64), join(values, np.float32), np.array(lengths, np.int64)


class FactorisationMachine:
    def __init__(self, bits: int = 16, rank: int = 8, seed: int = 7):
        self.bits, self.rank = bits, rank
        n, draw = _STATS + (1 << bits), np.random.default_rng(seed)
        self.b, self.w = np.float32(0), np.zeros(n, np.float32)
        self.v = draw.normal(0, 0.02, (n, rank)).astype(np.float32)

    def _sums(self, slots, values, starts):
        vx = self.v[slots] * values[:, None]
        s, q = np.add.reduceat(vx, starts), np.add.reduceat(vx * vx, starts)
        linear = np.add.reduceat(self.w[slots] * values, starts)
        return s, self.b + linear + 0.5 * (s * s - q).sum(axis=1)

    def score(self, slots, values, lengths) -> np.ndarray:
        if not len(lengths):
            return np.empty(0)
        _, y = self._sums(slots, values, np.cumsum(lengths) - lengths)
        return 1 / (1 + np.exp(-np.clip(y.astype(float), -30, 30)))

    def fit(self, slots, values, lengths, labels, epochs: int = 12, rate: float = 0.02, decay: float = 1e-4, batch: int = 64, seed: int = 7):
        """Adam on the logistic loss; both classes weigh the same in total up to a factor of 4."""
        draw, n = np.random.default_rng(seed), len(labels)
        share = float(np.clip(labels.mean(), 0.05, 0.95)) if n else 0.5
        weights = np.where(labels > 0.5, 0.5 / share, 0.5 / (1 - share)).clip(0.25, 4)
        starts = np.cumsum(lengths) - lengths
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.w, self.v)]
        turn = 0
        for _ in range(epochs):
            for part in np.array_split(draw.permutation(n), max(1, n // batch)):
                if not len(part):
                    continue
                turn += 1
                own = lengths[part]
                at = np.repeat(starts[part] - (np.cumsum(own) - own), own) + np.arange(own.sum())
                sl, x, first = slots[at], values[at], np.cumsum(own) - own
                s, y = self._sums(sl, x, first)
                p = 1 / (1 + np.exp(-np.clip(y, -30, 30)))
                g = np.repeat(((p - labels[part]) * weights[part] / len(part)).astype(np.float32), own)
                self.b -= np.float32(rate * g[first].sum())
                order = np.argsort(sl, kind="stable")
                first = np.flatnonzero(np.diff(sl[order], prepend=-1))
                used, gx = sl[order][first], g * x
                gw = np.add.reduceat(gx[order], first)
                gv = np.add.reduceat((gx[:, None] * (np.repeat(s, own, axis=0) - self.v[sl] * x[:, None]))[order], first)
                for param, grad, (m, u) in zip((self.w, self.v), (gw, gv), state, strict=True):
                    grad = grad + decay * param[used]
                    m[used] = 0.9 * m[used] + 0.1 * grad
                    u[used] = 0.99 * u[used] + 0.01 * grad * grad
                    param[used] -= rate * (m[used] / (1 - 0.9**turn)) / (np.sqrt(u[used] / (1 - 0.99**turn)) + 1e-6)
        return self

    def udf(self):
        model = self

        @F.pandas_udf("double")
        def judge(texts: pd.Series) -> pd.Series:
            features, out = Features(model.bits), []
            for i in range(0, len(texts), 500):  # bounded feature arrays, whatever the batch
                out.append(model.score(*features.of(texts[i : i + 500])))
            return pd.Series(np.concatenate(out) if out else np.empty(0))

        return judge


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 3000, **machine) -> FactorisationMachine:
    """A machine from ``labels`` (doc_id, quality) and the texts of ``docs``."""
    rows = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded by `sample`
    known = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # a row each label
    model = FactorisationMachine(**machine)
    bits = model.bits

    def features(batches):
        made = Features(bits)
        for pdf in batches:
            for i, q, t in zip(pdf["doc_id"], pdf["quality"], pdf["text"], strict=True):
                slots, values, _ = made.of([t])
                yield pd.DataFrame({"doc_id": [i], "quality": [q], "slots": [slots], "x": [values]})

    got = known.mapInPandas(features, "doc_id long, quality double, slots array<long>, x array<float>").toPandas()
    if not len(got):
        return model
    got = got.sort_values("doc_id", kind="stable")
    lengths = got["slots"].map(len).to_numpy(np.int64)
    return model.fit(np.concatenate(got["slots"].to_list()), np.concatenate(got["x"].to_list()).astype(np.float32), lengths, got["quality"].to_numpy(float))


def score_quality(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 where score >= threshold)."""
    scored = docs.withColumn("score", model.udf()(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
