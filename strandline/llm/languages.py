"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three code points of the lower-cased whole text are hashed to a fixed
number of buckets.  A bucket's value is its share of the text's n-grams times its inverse
document frequency, which is counted over all documents to learn from.  The weights are
trained by follow-the-regularised-leader (proximal) with an elastic net, on a sample of
labelled rows bounded for each language; a fifth of it sets the softmax temperature.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.shared import fold

BITS = 16
BUCKETS = 1 << BITS
LETTER = re.compile(r"[^\W\d_]")
#: Longer texts are hashed in parts, so that memory stays bounded.
PART_CHARS = 1 << 20
SCALE = 100.0
UNDETERMINED = "und"


def _hashed(codes: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams that begin at each code point; bucket 0 is none."""
    a = codes * np.uint32(0x9E3779B1)
    out = [a]
    if len(codes) > 1:
        b = a[:-1] * np.uint32(0x85EBCA77) + codes[1:] * np.uint32(0xC2B2AE3D) + np.uint32(1)
        out.append(b)
        if len(codes) > 2:
            out.append(b[:-1] * np.uint32(0x27D4EB2F) + codes[2:] * np.uint32(0x165667B1) + np.uint32(2))
    for x in out:
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x >>= np.uint32(32 - BITS)
        np.maximum(x, 1, out=x)
    return out


def buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(starts of the parts' texts, bucket arrays): runs of whole texts, or parts of a long one, with the text's number."""
    held: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        low = text.lower()
        for at in range(0, max(len(low), 1), PART_CHARS):
            part = low[at : at + PART_CHARS + 2]
            if held and size + len(part) > PART_CHARS:
                yield _run(held)
                held, size = [], 0
            held.append((i, part))
            size += len(part)
    if held:
        yield _run(held)


def _run(held: list[tuple[int, str]]) -> tuple[np.ndarray, list[np.ndarray]]:
    lengths = np.array([len(p) for _, p in held], np.int64)
    codes = np.frombuffer("".join(p for _, p in held).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lengths)
    kinds = _hashed(codes)
    for n, x in enumerate(kinds):  # n-grams that run over a text's end are none
        for back in range(1, n + 1):
            at = ends[lengths >= back] - back
            x[at[at < len(x)]] = 0
    return np.column_stack([[i for i, _ in held], ends - lengths, ends]), kinds


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, and how often it has them."""
    found = [x for _, kinds in buckets([text]) for x in kinds]
    at, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    return at[at > 0], n[at > 0]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # [BUCKETS, languages], inverse document frequencies multiplied in
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        sums, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for spans, kinds in buckets(texts):
            for x in kinds:
                lo, hi = np.minimum(spans[:, 1], len(x)), np.minimum(spans[:, 2], len(x))
                full = hi > lo
                if full.any():
                    rows = spans[full, 0]
                    np.add.at(sums, rows, np.add.reduceat(self.weights[x], lo[full], axis=0) if len(x) else 0)
                    np.add.at(total, rows, np.add.reduceat((x > 0).astype(np.int64), lo[full]))
        return SCALE * sums / np.maximum(total, 1)[:, None] + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, documents that have each bucket): partitions count, and their counts are summed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                mark = np.zeros(BUCKETS, bool)
                for _, kinds in buckets([text or ""]):
                    for x in kinds:
                        mark[x] = True
                df += mark
                n += 1
        df[0] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return int(out[0]), out


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], n_languages: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal on (buckets, values, language) samples: weights and bias."""
    z, n = np.zeros((BUCKETS, n_languages)), np.zeros((BUCKETS, n_languages))
    zb, nb = np.zeros(n_languages), np.zeros(n_languages)
    for _ in range(epochs):
        for at, x, y in samples:
            za, na = z[at], n[at]
            w = np.where(np.abs(za) > l1, -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2), 0)
            b = -zb / ((beta + np.sqrt(nb)) / alpha + l2)
            p = softmax((x @ w + b)[None])[0]
            p[y] -= 1
            g = x[:, None] * p
            z[at] = za + g - (np.sqrt(na + g * g) - np.sqrt(na)) / alpha * w
            n[at] = na + g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * b
            nb += p * p
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0)
    return w, -zb / ((beta + np.sqrt(nb)) / alpha + l2)


def fit(
    docs: DataFrame,
    max_rows: int = 1500,
    alpha: float = 0.1,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.1,
    epochs: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model | None:
    """Learns from rows with text and language outside fold 2; None if there are none.

    ``max_rows`` bounds the sampled rows of each language, chosen by hash of the id;
    document frequencies are counted over all rows to learn from.  The model has a row of
    weights a language, and the driver holds the samples' n-grams of all languages, so their
    number must be that of a language's table, not of the rows.  Of languages with equal
    probability the first by name is predicted.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").where(F.coalesce(fold(F.col("key")), F.lit(0)) != 2)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    share = F.pmod(F.xxhash64("key", F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    most = F.coalesce(*(F.when(F.col("lang") == k, F.lit(max_rows / n)) for k, n in sizes.items()))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([a.astype("<u4").tobytes() for a, _ in found], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary())],
                names=["key", "lang", "at", "n"],
            )

    sample = rows.where(share < most).mapInArrow(drawn, "key long, lang string, at binary, n binary").collect()  # about max_rows for each language
    total, df = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + df)) + 1
    idf[0] = 0
    data = []
    for r in sorted(sample, key=lambda r: (hash_order(r["key"]), r["lang"])):
        at, n = np.frombuffer(bytes(r["at"]), "<u4").astype(np.int64), np.frombuffer(bytes(r["n"]), "<u4")
        data.append((at, SCALE * n / max(int(n.sum()), 1) * idf[at], languages.index(r["lang"])))
    tune, learn = data[::5], [x for i, x in enumerate(data) if i % 5]
    learn = learn or tune
    w, b = train(learn, len(languages), alpha, beta, l1, l2, epochs)
    logits = np.array([x @ w[at] + b for at, x, _ in tune])
    truth = np.array([y for _, _, y in tune])
    grid = np.geomspace(0.1, 10, 81)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    return Model(languages, (w * idf[:, None]).astype(np.float32), b, float(grid[int(np.argmin(loss))]))


def hash_order(key: int | None) -> int:
    return (0 if key is None else key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF


KIND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(text: Column, model: Model | None) -> Column:
    """(lang_pred, score); ``und`` with score 0 for a text that is null or has no letter, and for all without a model."""

    @F.arrow_udf(KIND)
    def predicted(text: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if model is not None and t and LETTER.search(t)]
        for lo in range(0, len(at), 512):
            part = at[lo : lo + 512]
            p = model.probabilities([texts[i] for i in part])
            for i, best, top in zip(part, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                lang[i], score[i] = model.languages[best], top
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    return predicted(text.cast("string"))
