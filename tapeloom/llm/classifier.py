"""Quality classifier: naive Bayes support vectors.

Features are indicators of a whole text's word unigrams and bigrams and byte trigrams, hashed into
``2**BITS`` places. Each is scaled by its class log-count ratio; a linear hinge-loss model is fit on
the scaled, length-normalised indicators by dual coordinate descent; a logistic curve fit on a part
of the sample that the model has not seen turns margins into scores.

The fit uses a bounded sample: the ``TRAIN_ROWS`` labelled rows of least hash of the id (documented
parameter). Scoring covers every text. Only the text is an input of a score.

Cases: null and empty texts have no features and get the score of the bias alone; unlabelled or
null labels are not learnt from; documents or labels with repeated ids count as they are; with
no labelled row, or one class, the score is that class's share (0.5 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import shared

BITS = 18
TRAIN_ROWS = 12_000
THRESHOLD = 0.3


def features(raw: np.ndarray, bounds: np.ndarray, bits: int = BITS):
    """Each text's sorted distinct feature numbers."""
    words, at = shared.word_hashes(raw, bounds, fold=False)
    half, shift = 1 << (bits - 1), np.uint64(65 - bits)
    with np.errstate(over="ignore"):
        ones = (words >> shift).astype(np.int64)
        twos = (shared.mix(words[:-1] * np.uint64(3) + words[1:]) >> shift).astype(np.int64) if len(words) > 1 else ones[:0]
        b = raw.astype(np.uint32)
        threes = (((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(33 - bits)).astype(np.int64) + half) if len(b) > 2 else ones[:0]
    flags = np.zeros(2 * half, bool)
    for d in range(len(bounds) - 1):
        x, y = at[d], at[d + 1]
        flags[ones[x:y]] = True
        flags[twos[x : max(x, y - 1)]] = True
        flags[threes[bounds[d] : max(bounds[d], bounds[d + 1] - 2)]] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        yield found


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, c: float = 1.0, epochs: int = 12) -> dict:
    """Model: ``weight`` and ``ratio`` per feature, bias, and the curve's slope and intercept."""
    size = 1 << bits
    share = float(labels.mean()) if len(labels) else 0.5
    if len(labels) < 2 or labels.min() == labels.max():
        return {"weight": np.zeros(size, np.float32), "ratio": np.zeros(size, np.float32), "bias": 0.0, "slope": 0.0, "intercept": float(np.log((share + 1e-3) / (1 - share + 1e-3)))}
    counts = [np.ones(size), np.ones(size)]
    for x, y in zip(rows, labels, strict=True):
        counts[int(y)][x] += 1
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    held = np.arange(len(rows)) % 5 == 4
    if len(set(labels[held])) < 2 or len(set(labels[~held])) < 2:
        held[:] = False
    sign = np.where(labels == 1, 1.0, -1.0)
    values = [ratio[x] / max(np.sqrt((ratio[x] ** 2).sum()), 1e-9) for x in rows]
    norm = np.array([(v**2).sum() + 1.0 for v in values])
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    balance = np.where(labels == 1, c, c * max(1.0, labels.mean() / max(1 - labels.mean(), 1e-9)))
    rng, own = np.random.default_rng(7), np.flatnonzero(~held)
    for _ in range(epochs):
        for i in rng.permutation(own):
            x, v = rows[i], values[i]
            gradient = sign[i] * (w[x] @ v + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), balance[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[x] += step * v
                bias += step
                alpha[i] = new
    part = np.flatnonzero(held if held.any() else ~held)
    margin = np.array([w[rows[i]] @ values[i] + bias for i in part])
    slope, intercept, y = 1.0, 0.0, (labels[part] * (len(part) - 2) + 1) / len(part) if len(part) > 4 else labels[part] * 0.8 + 0.1
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(slope * margin + intercept, -30, 30)))
        s = p * (1 - p) + 1e-6
        g = np.array([((p - y) * margin).sum() + 1e-3 * slope, (p - y).sum()])
        h = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        slope, intercept = slope - step[0], intercept - step[1]
        if abs(step).max() < 1e-8:
            break
    return {"weight": w.astype(np.float32), "ratio": ratio.astype(np.float32), "bias": float(bias), "slope": float(slope), "intercept": float(intercept)}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> dict:
    """Fit on at most ``rows`` labelled rows outside the held-out fold (crc32 of the id mod 5 is 0)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    sample = known.filter(shared.id_crc() % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    chosen = shared.text_of(docs).join(F.broadcast(sample), "doc_id")  # at most ``rows`` rows

    def run(batches):
        for batch, raw, bounds in shared.chunks(batches):
            found = [x.astype("<u4").tobytes() for x in features(raw, bounds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "label", "features"])

    got = chosen.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, features binary").toArrow().sort_by("doc_id")
    return fit([np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in got["features"]], got["label"].to_numpy().astype(float))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted of every document (narrow)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, whatever the input

    def run(batches):
        m = shipped.value
        scaled, square = m["weight"] * m["ratio"], m["ratio"] ** 2
        for batch, raw, bounds in shared.chunks(batches):
            margin = np.array([m["bias"] + scaled[x].sum(dtype=float) / max(np.sqrt(square[x].sum(dtype=float)), 1e-9) for x in features(raw, bounds)])
            p = 1 / (1 + np.exp(-np.clip(m["slope"] * margin + m["intercept"], -30, 30)))
            yield shared.arrow(doc_id=batch.column(0), score=p)

    out = shared.text_of(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(shared.id_crc() % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
