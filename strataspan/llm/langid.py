"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspan.llm.common import slices, small_batches

#: Subwords are the n-grams of these many UTF-8 bytes of the lower-cased text, spaces included.
ORDERS = (2, 3, 4)
BUCKETS, DIM = 1 << 16, 16
#: The bounded training sample: about so many documents of each language, of all together, and their characters; one of over a 64th of those is not taken.
PER_LANG, SAMPLE, SAMPLE_CHARS = 600, 6000, 64_000_000
EPOCHS, RATE, BATCH = 30, 0.5, 64
#: Of the calibration documents, the part that rejection may lose.
MISS = 0.001
UNKNOWN = "und"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 16)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def hashed(data: np.ndarray) -> list[np.ndarray]:
    """For each order n, the bucket of the n-gram that starts at each byte (the last n-1 have none)."""
    out = []
    grams = data.astype(np.uint64)
    for n in range(2, max(ORDERS) + 1):
        grams = grams[:-1] << np.uint64(8) | data[n - 1 :]
        if n in ORDERS:
            out.append((((grams + np.uint64(n)) * _ODD) >> _SHIFT).astype(np.int32))
    return out


def encoded(text: str) -> np.ndarray:
    return np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), dtype=np.uint8)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    scores: np.ndarray  # BUCKETS x langs: each bucket's embedding times the softmax weights
    bias: np.ndarray
    temperature: float
    reject: float  # least calibrated probability that is not rejected

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated probability and whether it is rejected, for each whole text.

        The mean of embeddings times the weights is the mean of `scores`, so a text costs one gather
        a subword. Texts are laid end to end; subwords that straddle two texts are left out.
        """
        known = [t is not None and has_letter(t) for t in texts]
        langs, probs, reject = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        rows = [i for i, k in enumerate(known) if k]
        if rows and self.langs:
            logits = np.stack([self._logits(encoded(texts[i])) for i in rows]) / self.temperature
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            probs[rows] = p[np.arange(len(rows)), best]
            reject[rows] = probs[rows] < self.reject
            for i, b in zip(rows, best, strict=True):
                langs[i] = self.langs[b]
        return langs, probs, reject

    def _logits(self, data: np.ndarray) -> np.ndarray:
        total, n = np.zeros(self.scores.shape[1]), 0
        for lo in range(0, len(data), 1 << 18):  # bounded work space for very long texts
            for order, h in zip(ORDERS, hashed(data[lo : lo + (1 << 18) + max(ORDERS) - 1]), strict=True):
                h = h[: max(0, min(1 << 18, len(data) - order + 1 - lo))]
                total += self.scores.take(h, axis=0).sum(0, dtype=np.float64)
                n += len(h)
        return total / max(n, 1) + self.bias


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Fit on whole texts, four in five for SGD and the rest for the temperature and the rejection threshold."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    bags = []
    for t in texts:
        ids, counts = np.unique(np.concatenate(hashed(encoded(t))), return_counts=True)
        bags.append((ids, (counts / counts.sum()).astype(np.float32)))
    y = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(texts))
    cut = max(1, len(texts) * 4 // 5)
    fit, held = order[:cut], order[cut:]
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    weights += rng.normal(0, 0.1, weights.shape).astype(np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for lo in range(0, len(fit), BATCH):
            some = rng.permutation(fit)[:BATCH] if lo + BATCH > len(fit) else fit[lo : lo + BATCH]
            mean = np.stack([bags[i][1] @ emb[bags[i][0]] for i in some])
            z = mean @ weights + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            back = p @ weights.T
            weights -= rate * mean.T @ p
            bias -= rate * p.mean(0) * 0.1
            # a text's step is spread over its subwords by their shares, so it is short; its length is bounded all the same
            back *= np.minimum(1, 1 / np.maximum(np.linalg.norm(back, axis=1, keepdims=True), 1e-6))
            for i, g in zip(some, back, strict=True):
                emb[bags[i][0]] -= rate * np.outer(bags[i][1], g) * 20
            weights *= min(1, 30 / max(float(np.linalg.norm(weights)), 1e-6))
        fit = rng.permutation(fit)
    scores = emb @ weights
    seen = np.zeros(BUCKETS, bool)
    for i in order[:cut]:
        seen[bags[i][0]] = True
    scores[~seen] = 0  # subwords that no text had say nothing, so an unknown language is left unsure
    held = held if len(held) else fit
    logits = np.stack([bags[i][1] @ scores[bags[i][0]] + bias for i in held])

    def probs(t: float) -> np.ndarray:
        p = np.exp((logits - logits.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    # Smoothed targets keep the temperature finite where every calibration document is right.
    target = np.full((len(held), len(names)), 1 / (len(held) + 2) / max(1, len(names) - 1))
    target[np.arange(len(held)), y[held]] = 1 - 1 / (len(held) + 2)
    temperature = float(min(np.geomspace(0.01, 20, 80), key=lambda t: -(target * np.log(probs(t) + 1e-12)).sum(1).mean()))
    p = probs(temperature)
    sure = p.max(1)[p.argmax(1) == y[held]]
    # a prediction is rejected if it is less sure than nearly all right ones, and nearer to a guess than to certainty
    even = 1 / len(names)
    reject = min((1 + even) / 2, float(np.quantile(sure, MISS))) if len(sure) else 0.0
    return Model(names, scores.astype(np.float32), bias.astype(np.float64), temperature, reject)


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, per_lang: int = PER_LANG, most: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list:
    """A bounded sample of labelled documents outside the held-out third: about `per_lang` of each language.

    One pass counts languages (a few rows). Each document has a hash of its id, divided by the share of its language that is wanted, so that the order is
    fair between frequent and rare ones; the `most` first documents make the sample, or fewer, so that they have `chars` characters at most. The driver
    first gets their numbers, then the texts.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_lang / r["count"]))])
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) / F.element_at(share, F.col("lang"))
    rows = rows.withColumn("u", u).withColumn("size", F.length("text")).where((F.col("u") < 1) & (F.col("size") <= chars // 64))
    first, total, last = rows.select("u", "size").orderBy("u", "size").limit(most).collect(), 0, -1.0
    for r in first:
        total += r["size"]
        if total > chars:
            break
        last = r["u"]
    return rows.where(F.col("u") <= last).orderBy("u", "doc_id", "text").limit(most).select("text", "lang").collect()


def fit(docs: DataFrame, per_lang: int = PER_LANG, most: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """A model of the labelled documents outside the held-out third; one that knows no language if there are none."""
    got = [r for r in sample(docs, per_lang, most, chars) if has_letter(r["text"])]
    return train([r["text"] for r in got], [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """Predict the language of every whole text.

    Input doc_id, text and the columns in `keep`. Null text, or text without a letter, gives `und`, score 0 and
    is rejected; so does everything if nothing was learned. Repeated rows repeat; an empty table gives no rows. Returns `keep`, doc_id, text and,
    with `prefix` before their names, lang_pred, score (calibrated probability), rejected. Names that are in `keep` already are refused.
    """
    columns = [*dict.fromkeys([*keep, "doc_id", "text"])]
    if clash := {prefix + x for x in ("lang_pred", "score", "rejected")} & set(columns):
        raise ValueError(f"columns {sorted(clash)} are in the way; give a prefix")
    small_batches(docs.sparkSession)
    names = [prefix + x for x in ("lang_pred", "score", "rejected")]
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x langs floats, whatever the input

    def run(batches):
        m = broadcast.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for a, b in slices(lengths):
                part = batch.slice(a, b - a)
                langs, probs, reject = m.predict(part.column(part.schema.get_field_index("text")).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(probs), pa.array(reject)], [*columns, *names])

    schema = docs.select(*columns).schema
    for name, kind in zip(names, ("string", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return docs.select(*columns).mapInArrow(run, schema)
