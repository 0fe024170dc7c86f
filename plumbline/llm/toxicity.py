"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its distinct lower-case words, the first letters of its longer words (once
more for every doubling of the number of words that share them) and its size, each hashed to one of ``2**BITS`` slots. The machine has a weight and a ``RANK``-vector for each slot:
score = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>), so a pair of terms (an insult beside a
group's name, or beside another insult, or in a short text) can weigh more than its parts. The
linear weights start at zero, move slowly and are held small, so that the pairs decide; without
its vectors the machine finds nothing. It is trained in numpy on the driver from a bounded
sample of labelled texts and applied to every text on the executors; the model's size is fixed.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches

BITS = 18
RANK = 4
#: Labelled texts that training takes at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 12_000
PREFIX = 5
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_MASK = (1 << BITS) - 1


def _slot(kind: bytes, term: bytes) -> int:
    return zlib.crc32(term, zlib.crc32(kind)) & _MASK


#: Slots of a text's size (distinct words, in powers of two); always part of the machine, so its
#: pairs can weigh a count of terms against the length.
SIZES = [_slot(b"#", str(k).encode()) for k in range(32)]


class Terms:
    """Slots of a text's terms; remembers words, boundedly."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, bytes | None]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = set(_WORD.findall((text or "").lower().encode("utf-8", "surrogatepass")))
        if len(self.known) > 400_000:
            self.known.clear()
        known, slots, starts = self.known, set(), []
        for w in words:
            s = known.get(w)
            if s is None:
                letters = w.decode("utf-8", "replace")
                s = known[w] = (_slot(b"=", w), letters[:PREFIX].encode() if len(letters) > PREFIX else None)
            slots.add(s[0])
            if s[1] is not None:
                starts.append(s[1])
        for start, n in Counter(starts).items():
            slots.update(_slot(b"^%d" % k, start) for k in range(min(n.bit_length(), 4)))
        if words:
            slots.add(SIZES[len(words).bit_length()])
        return np.fromiter(slots, np.int32, len(slots))


@dataclass
class Machine:
    """A factorization machine; ``vectors`` is (slots, rank)."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of texts whose slots lie one after another in ``slots``."""
        if not len(sizes):
            return np.zeros(0)
        used = np.append(slots, 0)  # reduceat needs a place even for trailing empty texts
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        line = np.add.reduceat(self.weights[used], starts)
        v = self.vectors[used]
        total, square = np.add.reduceat(v, starts, axis=0), np.add.reduceat(v * v, starts, axis=0)
        out = self.bias + line + 0.5 * (total * total - square).sum(axis=1)
        return np.where(sizes > 0, out, self.bias)

    def scores(self, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(slots, sizes), -30, 30)))


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.05,
          linear_rate: float = 0.005, l1: float = 0.02, l2: float = 1e-4, linear_l2: float = 0.02, seed: int = 7) -> Machine:
    """Fit by proximal AdaGrad on the logistic loss; ``texts`` are arrays of slots.

    Only slots whose presence differs between the classes beyond chance take part; the rest keep
    weight zero, so a rare word of one text is not learnt by heart. Without two classes the
    machine returns the observed rate for every text.
    """
    rng = np.random.default_rng(seed)
    n, positive = len(labels), float(labels.sum())
    rate_1 = (positive + 0.5) / (n + 1.0)
    machine = Machine(float(np.log(rate_1 / (1 - rate_1))), np.zeros(1 << BITS, np.float32),
                      np.zeros((1 << BITS, RANK), np.float32))
    if positive in (0.0, float(n)):
        return machine
    sizes = np.array([len(t) for t in texts])
    flat = np.concatenate(texts)
    hot = np.repeat(labels, sizes)
    df = np.bincount(flat, minlength=1 << BITS)
    df1 = np.bincount(flat, weights=hot, minlength=1 << BITS)
    share = positive / n
    z = (df1 - df * share) / np.sqrt(df * share * (1 - share) * np.maximum(1 - df / n, 1e-6) + 1e-9)
    chosen = (np.abs(z) > 4.0) & (df >= 3)
    chosen[SIZES] = df[SIZES] > 0
    texts = [t[chosen[t]] for t in texts]
    machine.vectors[chosen] = rng.normal(0.1, 0.02, (int(chosen.sum()), RANK))
    gw = np.full(1 << BITS, 1e-2, np.float32)
    gv = np.full((1 << BITS, RANK), 1e-2, np.float32)
    g0 = 1e-2
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, n // batch)):
            own = [texts[i] for i in part]
            sizes = np.array([len(t) for t in own])
            used = np.concatenate(own)
            error = machine.scores(used, sizes) - labels[part]
            owner = np.repeat(np.arange(len(part)), sizes)
            g = float(error.mean())
            g0 += g * g
            machine.bias -= rate * g / np.sqrt(g0)
            if not len(used):
                continue
            v = machine.vectors[used]
            total = np.zeros((len(part), RANK), np.float32)
            np.add.at(total, owner, v)
            slots, inverse = np.unique(used, return_inverse=True)
            dw = np.bincount(inverse, weights=error[owner], minlength=len(slots)) / len(part)
            dw += linear_l2 * machine.weights[slots]
            dv = np.zeros((len(slots), RANK), np.float32)
            np.add.at(dv, inverse, error[owner, None] * (total[owner] - v) / len(part))
            dv += l2 * machine.vectors[slots]
            gw[slots] += dw * dw
            gv[slots] += dv * dv
            step = linear_rate / np.sqrt(gw[slots])
            w = machine.weights[slots] - step * dw
            machine.weights[slots] = np.sign(w) * np.maximum(np.abs(w) - step * l1 / len(part), 0)
            machine.vectors[slots] -= rate * dv / np.sqrt(gv[slots])
    return machine


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        rows: int = TRAIN_ROWS) -> Machine:
    """Train on at most ``rows`` labelled texts that aren't held out, chosen by the hash of their ids.

    The ids of the sample are found first, from the label table alone, so only their texts move.
    Null labels and ids are left out. An id that is labelled or found more than once counts once, with
    its largest label and, of its texts, the one whose terms come first. Without labels the score is
    the same for every text.
    """
    known = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("label"))
             .where("id is not null and label is not null and not isnan(label)").where(~held_out("id"))
             .groupBy("id").agg(F.max("label").alias("label")))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(rows)  # rows bound: safe to broadcast

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches(frames, 500):
            slots = [terms(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([np.sort(s).tobytes() for s in slots], pa.binary())],
                names=["id", "label", "slots"])

    found = (docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
             .join(F.broadcast(sample), "id").select("id", "label", "text")
             .mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, label double, slots binary")
             .groupBy("id").agg(F.min("slots").alias("slots"), F.min("label").alias("label")).toArrow())
    table = sorted(zip(*(found.column(c).to_pylist() for c in ("id", "slots", "label")), strict=True))
    if not table:
        return train([np.zeros(0, np.int32)], np.zeros(1))
    return train([np.frombuffer(s, np.int32) for _, s, _ in table], np.array([x > 0 for *_, x in table], float))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row: between 0 and 1, higher for likelier toxic texts.

    Null and empty texts have no terms and get the base rate. No shuffle; texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weights, machine.vectors))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, terms = Machine(*shared.value), Terms()
        for batch in batches(frames, 200):
            slots = [terms(x.as_py()) for x in batch.column(1)]
            sizes = np.array([len(s) for s in slots], np.int64)
            made = own.scores(np.concatenate(slots) if slots else np.zeros(0, np.int32), sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], names=["id", "score"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, f"id {docs.schema[id_col].dataType.simpleString()}, score double")
