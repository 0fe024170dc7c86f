"""Masked pseudo-likelihood scores of documents.

A small bidirectional window network, trained in numpy, predicts every token from the tokens on
both of its sides; the sum of these conditional log-probabilities scores a document.

Every word of the corpus is scored as itself: the network predicts the word's id, and a word that
shares its id with others gets its share of the id's occurrences, counted over the whole corpus,

    log P(word | both sides) = log P(id | both sides) + log(count of the word / count of the id).

1. All words are counted; the counts are a table in the shared folder that grows with the corpus.
   The ``OWN`` most frequent words have ids of their own, the others share the rest by their hash.
2. The network is trained on every token in rounds over growing shares of the texts. In a round,
   texts are dealt to shards of about ``SHARD_TOKENS`` tokens by their hash, each shard trains a copy,
   and the copies are averaged by tokens before the next round. Rounds, shards and the order inside
   follow from the rows alone, so a score doesn't depend on partitions or executors.
3. Every token of every document is scored; only the words that share ids are joined with the counts.
   One such word makes up at most 1 in ``OWN`` of all tokens, so no key of the join is hot.

The network's size is fixed, so what reaches the driver is bounded whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches, materialise, release

TOKENS = 4096  #: token ids; 0 pads
OWN = 3072  #: ids of single words; the other ids are shared by hash
DIM = 16
SIDE = 2  #: tokens on either side
CLASS = 64  #: an id is predicted as its class, then as its place in the class
BATCH = 4096
RATE = 0.08
#: Sixteenths of the texts after which each round ends: soon while the copies are far from each other.
ROUNDS = (1, 2, 4, 8, 16)
#: Tokens of all rounds that one copy of the network learns from.
SHARD_TOKENS = 4_000_000
#: Tokens that are counted at a time.
_WINDOW = 1 << 20
_OFFSETS = [*range(-SIDE, 0), *range(1, SIDE + 1)]
_BLOCK = 1 << 11
#: Last bits of a hash by which a vocabulary finds its place.
_PLACE_BITS = 20


def word_hashes(text: str | None) -> np.ndarray:
    """A signed 64-bit hash for each white-space word, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


@dataclass(frozen=True)
class Vocabulary:
    """``own``: ascending hashes of the words with ids of their own; ``ids``: these ids, by falling
    frequency from 1; ``shared``: the number of ids that other words share, the last ones; ``place``: at a
    hash's last bits the place in ``own`` where that hash, if any, would be."""

    own: np.ndarray
    ids: np.ndarray
    shared: int
    place: np.ndarray

    @classmethod
    def of(cls, frequent: np.ndarray, shared: int) -> Vocabulary:
        order = np.argsort(frequent, kind="stable")
        own = frequent[order]
        place = np.zeros(1 << _PLACE_BITS, np.int16)
        place[own & ((1 << _PLACE_BITS) - 1)] = np.arange(len(own))
        return cls(own, (order + 1).astype(np.int32), shared, place)

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, and which of them share their id."""
        if not len(self.own):
            return (TOKENS - self.shared + np.mod(hashes, self.shared)).astype(np.int32), np.ones(len(hashes), bool)
        at = self.place[hashes & ((1 << _PLACE_BITS) - 1)]
        ids, other = self.ids[at], np.flatnonzero(self.own[at] != hashes)
        rest = hashes[other]
        # own words whose place another own word has taken are searched for
        near = np.minimum(np.searchsorted(self._hidden, rest), len(self._hidden) - 1) if len(self._hidden) else None
        if near is not None:
            found = self._hidden[near] == rest
            ids[other[found]] = self.ids[np.searchsorted(self.own, rest[found])]
            other, rest = other[~found], rest[~found]
        ids[other] = TOKENS - self.shared + np.mod(rest, self.shared)
        shares = np.zeros(len(hashes), bool)
        shares[other] = True
        return ids, shares

    @cached_property
    def _hidden(self) -> np.ndarray:
        return self.own[self.place[self.own & ((1 << _PLACE_BITS) - 1)] != np.arange(len(self.own))]


SHAPES = {"embed": (TOKENS, DIM), "place": (2 * SIDE, DIM), "bias": (DIM,), "w1": (DIM, TOKENS // CLASS),
          "b1": (TOKENS // CLASS,), "cls": (TOKENS // CLASS, DIM), "w2": (DIM, CLASS), "b2": (CLASS,)}


@dataclass
class Network:
    """Weights by name; ``flat`` and ``of`` turn them into one vector and back."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        w = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in SHAPES.items()}
        for k in ("bias", "b1", "b2"):
            w[k][:] = 0
        w["place"][:] = 1 / np.sqrt(2 * SIDE)
        return cls(w)

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for k, s in SHAPES.items():
            n = int(np.prod(s))
            out[k] = flat[at:at + n].reshape(s).astype(np.float32)
            at += n
        return cls(out)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights[k].ravel() for k in SHAPES])

    def forward(self, line: np.ndarray, normed: bool = False):
        """Of a line of ids with ``SIDE`` more at either end: the embedded line, the rows of real
        tokens, hidden layer, both softmaxes and the log-probability of every token."""
        w, n = self.weights, len(line) - 2 * SIDE
        x = w["embed"][line]
        z = w["bias"] + np.zeros((n, DIM), np.float32)
        for p, o in enumerate(_OFFSETS):
            z += x[SIDE + o:SIDE + o + n] * w["place"][p]
        at = np.flatnonzero(line[SIDE:SIDE + n])
        target = line[SIDE + at]
        h = np.tanh(z[at])
        c1, c2 = target // CLASS, target % CLASS
        rows = np.arange(len(target))
        p1, l1 = _softmax(h @ w["w1"] + w["b1"], rows, c1, normed)
        u = h + w["cls"][c1]
        p2, l2 = _softmax(u @ w["w2"] + w["b2"], rows, c2, normed)
        return x, at, h, u, p1, p2, c1, c2, l1 + l2

    def gradients(self, line: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-probability of the line's tokens; none without tokens."""
        w, n = self.weights, len(line) - 2 * SIDE
        x, at, h, u, p1, p2, c1, c2, _ = self.forward(line, True)
        if not len(at):
            return {}
        rows = np.arange(len(at))
        p1[rows, c1] -= 1
        p2[rows, c2] -= 1
        du = p2 @ w["w2"].T
        dz = np.zeros((n, DIM), np.float32)
        dz[at] = (p1 @ w["w1"].T + du) * (1 - h * h)
        one = np.ones(max(n, len(at)), np.float32)
        grads = {"w1": h.T @ p1, "b1": one[:len(at)] @ p1, "w2": u.T @ p2, "b2": one[:len(at)] @ p2, "bias": one[:n] @ dz,
                 "cls": _scatter(c1, du, TOKENS // CLASS), "place": np.empty((2 * SIDE, DIM), np.float32)}
        back = np.zeros(x.shape, np.float32)
        for p, o in enumerate(_OFFSETS):
            grads["place"][p] = one[:n] @ (dz * x[SIDE + o:SIDE + o + n])
            back[SIDE + o:SIDE + o + n] += dz * w["place"][p]
        grads["embed"] = _scatter(line, back, TOKENS)
        return {k: g / np.float32(len(at)) for k, g in grads.items()}

    def step(self, line: np.ndarray, seen: dict[str, np.ndarray]) -> None:
        """One AdaGrad step; ``seen`` sums the squared gradients."""
        for k, g in self.gradients(line).items():
            seen[k] += g * g
            self.weights[k] -= RATE * g / np.sqrt(seen[k])


def _softmax(logits: np.ndarray, rows: np.ndarray, at: np.ndarray, normed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (only if ``normed``, else their multiples) and the log-probability at ``at``.

    Hidden units lie in [-1, 1] and weights are small, so no shift is needed below the clip.
    """
    np.clip(logits, -60, 60, out=logits)
    own = logits[rows, at]
    p = np.exp(logits, out=logits)
    total = p @ np.ones(p.shape[1], np.float32)
    if normed:
        p *= (1 / total)[:, None]
    return p, own - np.log(total)


def _scatter(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    places = np.multiply(at, DIM, dtype=np.int64)[:, None] + np.arange(DIM)
    return np.bincount(places.ravel(), weights=values.ravel(), minlength=n * DIM).reshape(n, DIM).astype(np.float32)


def lines(ids: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The texts in one padded line, in overlapping slices of ``BATCH`` tokens and their context."""
    pad = np.zeros(SIDE, np.int32)
    line = np.concatenate([pad, *(x for t in ids for x in (t, pad))])
    for i in range(0, len(line) - 2 * SIDE, BATCH):
        yield line[i:i + BATCH + 2 * SIDE]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): how often every word of the corpus occurs, by the word's hash; written as a table."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches(frames, 500):
            for x in batch.column(0):
                held.append(word_hashes(x.as_py()))
                size += len(held[-1])
                if size >= _WINDOW:
                    yield counted(held)
                    held, size = [], 0
        yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        words, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(n, pa.int64())], names=["word", "n"])

    parts = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "word long, n long")
    return materialise(parts.groupBy("word").agg(F.sum("n").alias("n")), "words")


@dataclass(frozen=True)
class Model:
    """``counts`` is the table (word, n); ``totals`` are the occurrences of each shared id."""

    vocabulary: Vocabulary
    counts: DataFrame
    totals: np.ndarray
    network: Network


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", own: int = OWN) -> Model:
    """Counts and a network learnt from every token of every text.

    Null, empty and blank texts have no tokens; repeated rows are learnt again; rows with a null id
    take part; an empty table gives the untrained network. Other columns are ignored.
    """
    counts = word_counts(docs, text_col)
    shared = TOKENS - 1 - own
    top = counts.orderBy(F.desc("n"), "word").limit(own).toArrow()  # ties by hash
    frequent, often = top.column("word").to_numpy(), top.column("n").to_numpy()
    sums = counts.groupBy(F.pmod("word", F.lit(shared)).cast("int").alias("c")).agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(shared, np.int64)
    totals[sums.column("c").to_numpy()] = sums.column("n").to_numpy()
    tokens = int(totals.sum())
    np.subtract.at(totals, np.mod(frequent, shared), often)
    vocabulary = Vocabulary.of(frequent, shared)
    return Model(vocabulary, counts, totals, train(_texts(docs, id_col, text_col), vocabulary, max(1, -(-tokens // SHARD_TOKENS))))


def train(texts: DataFrame, vocabulary: Vocabulary, shards: int) -> Network:
    """The network after all rounds over ``texts`` (id, text)."""
    context = texts.sparkSession.sparkContext

    def tokenise(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, 200):
            ids = [vocabulary(word_hashes(x.as_py()))[0].astype("<u2").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["key", "ids"])

    def learner(start):
        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, net, seen, tokens, held, size = None, None, None, 0, [], 0
            for batch in batches(frames, 200):
                for own, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if own != shard:
                        if shard is not None:
                            yield from copies(shard, net, seen, tokens, held)
                        shard, tokens, held, size = own, 0, [], 0
                        net, seen = Network.of(start.value[0]), Network.of(start.value[1]).weights
                    ids = np.frombuffer(raw, "<u2").astype(np.int32)
                    held.append(ids)
                    tokens += len(ids)
                    size += len(ids)
                    if size >= 8 * BATCH:
                        for line in lines(held):
                            net.step(line, seen)
                        held, size = [], 0
            if shard is not None:
                yield from copies(shard, net, seen, tokens, held)

        def copies(shard, net, seen, tokens, held) -> Iterator[pa.RecordBatch]:
            for line in lines(held):
                net.step(line, seen)
            both = np.concatenate([net.flat(), Network(seen).flat()])
            blocks = [both[i:i + _BLOCK].tobytes() for i in range(0, len(both), _BLOCK)]
            n = len(blocks)
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(n), pa.int32()), pa.array([shard] * n, pa.int32()), pa.array([float(tokens)] * n, pa.float64()),
                     pa.array(blocks, pa.binary())], names=["block", "shard", "tokens", "values"])

        return run

    def average(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by block and shard, so that sums don't depend on their arrival."""
        sums: dict[tuple[int, int], list] = {}
        for batch in frames:
            for block, shard, tokens, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.setdefault((block, shard % _SALTS), [0.0, 0.0])
                own[0] += tokens
                own[1] = own[1] + tokens * np.frombuffer(values, np.float32).astype(np.float64)
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([sums[k][0] for k in keys], pa.float64()),
             pa.array([(sums[k][1] / sums[k][0]).astype(np.float32).tobytes() for k in keys], pa.binary())],
            names=["block", "shard", "tokens", "values"])

    schema = "block int, shard int, tokens double, values binary"
    # a row's round and shard follow from its content; only identical rows share them of necessity
    keyed = texts.select(F.struct(
        F.pmod(F.xxhash64("id", "text", F.lit(1)), F.lit(ROUNDS[-1])).cast("int").alias("round"),
        F.pmod(F.xxhash64("id", "text", F.lit(2)), F.lit(shards)).cast("int").alias("shard"),
        F.xxhash64("id", "text").alias("place")).alias("key"), "text")
    # all rounds read the token ids, two bytes each, and none the texts
    numbers = materialise(keyed.mapInArrow(tokenise, "key struct<round:int,shard:int,place:long>, ids binary")
                          .where("length(ids) > 0").select("key.*", "ids"), "tokens")
    now = Network.fresh()
    seen = np.full(len(now.flat()), 1e-4, np.float32)
    for first, stop in zip((0, *ROUNDS), ROUNDS, strict=False):
        start = context.broadcast((now.flat(), seen))
        dealt = (numbers.where((F.col("round") >= first) & (F.col("round") < stop))
                 .select("shard", "place", "ids").repartition(shards, "shard")
                 .sortWithinPartitions("shard", "place", "ids").select("shard", "ids"))
        made = dealt.mapInArrow(learner(start), schema)
        # averages of up to _SALTS groups of shards meet, then one average per block: no task sees all copies
        salted = made.repartition("block", F.col("shard") % _SALTS).sortWithinPartitions("block", "shard")
        final = salted.mapInArrow(average, schema).toArrow()
        blocks: dict[int, list] = {}
        for block, shard, tokens, values in sorted(zip(*(final.column(c).to_pylist() for c in ("block", "shard", "tokens", "values")), strict=True)):
            own = blocks.setdefault(block, [0.0, 0.0])
            own[0] += tokens
            own[1] = own[1] + tokens * np.frombuffer(values, np.float32).astype(np.float64)
        start.unpersist()
        if blocks:
            both = np.concatenate([(blocks[b][1] / blocks[b][0]).astype(np.float32) for b in sorted(blocks)])
            now, seen = Network.of(both[:len(seen)]), both[len(seen):]
    release(numbers)
    return now


#: Groups of shards whose averages reach the driver: a bounded number of copies of a small network.
_SALTS = 16


def score_ids(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Summed conditional log-probabilities of each text's token ids."""
    logp = np.concatenate([np.zeros(0), *(net.forward(line)[-1] for line in lines(texts))])
    return np.bincount(np.repeat(np.arange(len(texts)), [len(t) for t in texts]), weights=logp, minlength=len(texts))


_RARE = pa.list_(pa.struct([("word", pa.int64()), ("times", pa.int32())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, sum_log_prob, mean_log_prob) for every row.

    Null, empty and blank texts have no tokens: sum 0, mean null. Texts are scored whole, in
    slices of tokens; repeated rows repeat their score; an empty table gives an empty result. A word
    that the model's corpus doesn't have counts as one occurrence of its id.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.totals, model.network.flat()))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, totals, flat = shared.value
        own, logs = Network.of(flat), np.log(np.maximum(totals, 1))
        for batch in batches(frames, 100):
            texts, rare, less = [], [], []
            for x in batch.column(1):
                hashes = word_hashes(x.as_py())
                ids, some = vocabulary(hashes)
                texts.append(ids)
                words, times = np.unique(hashes[some], return_counts=True)
                rare.append((words, times))
                less.append(float((logs[np.mod(words, vocabulary.shared)] * times).sum()))
            sums = score_ids(own, texts) - np.array(less)
            offsets = np.cumsum([0, *(len(w) for w, _ in rare)])
            structs = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([np.zeros(0, np.int64), *(w for w, _ in rare)]), pa.int64()),
                 pa.array(np.concatenate([np.zeros(0, np.int64), *(t for _, t in rare)]), pa.int32())], fields=list(_RARE.value_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(sums, pa.float64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs).cast(_RARE)],
                names=["id", "n_tokens", "base", "rare"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = materialise(
        _texts(docs, id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, base double, rare array<struct<word:long,times:int>>")
        .withColumn("row", F.monotonically_increasing_id()), "scored")
    # the logarithm of 1 is 0: words that occur once need no join
    more = model.counts.where("n > 1")
    found = (rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times").join(more, "word")
             .groupBy("row").agg(F.sum(F.col("times") * F.ln("n")).alias("shares")))
    total = F.col("base") + F.coalesce("shares", F.lit(0.0))
    return rows.drop("rare").join(found, "row", "left").select(
        "id", "n_tokens", total.alias("sum_log_prob"),
        F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_prob"))
