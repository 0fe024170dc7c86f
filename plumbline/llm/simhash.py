"""SimHash near-duplicate components by covering locality-sensitive hashing.

A fingerprint has 64 majority bits over the hashes of a text's word shingles. Two fingerprints
link when they differ in at most ``radius`` bits. Covering LSH (Pagh, 2016) gives every bit a
non-zero vector m(bit) of ``radius + 1`` bits; table v, for each non-zero v, keeps the bits with
<m(bit), v> = 1. For any ``radius`` bits there is a v that is orthogonal to all their vectors, so
two fingerprints that differ only there agree in table v: no linked pair is ever missed.

Only distinct fingerprints are tabled, so copies cost nothing. Buckets with more than ``LIMIT``
fingerprints are dealt out again by a second, independent covering of the remaining bits; inside,
bits are bounded in number, so a bucket is too. A bucket emits a spanning forest of its links,
never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches, components, forest, materialise, numbered, release

SEED = 42
LIMIT = 4096
_BLOCK = 512


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the ``width``-word shingles, repeats included; A-Z in lower case.

    Fewer words make one shingle; none (empty, null, white space) give zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *stops[: -width].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (stops[width - 1:] - 1).tolist(), strict=True)],
                          np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at:at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp signed long) for every row, without a shuffle."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, 500):
            made = np.array([fingerprint(x.as_py(), width) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def masks(radius: int, level: int = 0) -> list[int]:
    """The covering masks, signed. Level 1 spreads the bits independently of level 0."""
    n = (1 << (radius + 1)) - 1
    vector = [1 + (i % n if level == 0 else (i // n if n < 9 else i * 7 // n) % n) for i in range(64)]
    out = []
    for v in range(1, n + 1):
        kept = sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2)
        out.append(kept - (1 << 64) if kept >> 63 else kept)
    return out


def _links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, block by block."""
    unsigned = fps.view(np.uint64)
    a = b = np.zeros(0, np.int64)
    for i in range(0, len(fps), _BLOCK):
        for j in range(i, len(fps), _BLOCK):
            near = np.bitwise_count(unsigned[i:i + _BLOCK, None] ^ unsigned[None, j:j + _BLOCK]) <= radius
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            if (x < y).any():
                nodes, labels = forest(np.r_[a, x[x < y]], np.r_[b, y[x < y]])
                a, b = nodes[nodes != labels], labels[nodes != labels]
    return fps[a], fps[b]


def _linker(radius: int):
    """Over rows sorted by bucket: keeps one bucket in memory, emits its forest."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5), np.int64)

        def out(rows: np.ndarray) -> pa.RecordBatch:
            edges = [np.zeros((2, 0), np.int64)]
            if len(rows):
                cut = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
                starts, stops = np.r_[0, cut], np.r_[cut, len(rows)]
                sizes = stops - starts
                two = starts[sizes == 2]  # most buckets that matter hold a pair
                x, y = rows[two, 4], rows[two + 1, 4] if len(two) else rows[two, 4]
                near = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= radius
                edges.append(np.stack([x[near], y[near]]))
                for s, e in zip(starts[sizes > 2].tolist(), stops[sizes > 2].tolist(), strict=True):
                    edges.append(np.stack(_links(rows[s:e, 4].copy(), radius)))
            src, dst = np.concatenate(edges, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

        for batch in frames:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
            last = int(np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))[-1]) + 1 if (
                rows[0, :4] != rows[-1, :4]).any() else 0
            if last:
                yield out(rows[:last])
            held = rows[last:]
        yield out(held)

    return run


def _tabled(rows: DataFrame, fixed: list[str], level: int, radius: int) -> DataFrame:
    tables = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k"))
                       for t, m in enumerate(masks(radius, level))])
    return rows.select(*fixed, "fp", F.explode(tables).alias("x")).select(
        *fixed, F.col("x.t").alias(f"t{level}"), F.col("x.k").alias(f"k{level}"), "fp")


def links(distinct_fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (src, dst) that connect exactly what the links of ``distinct_fps`` (fp) connect."""
    first = _tabled(distinct_fps, [], 0, radius)
    # written, so adaptive execution can split a large bucket's rows in the join
    sizes = materialise(first.groupBy("t0", "k0").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    sized = first.join(sizes, ["t0", "k0"])
    small = sized.where(F.col("n") <= LIMIT).select("t0", "k0", F.lit(0).cast("long").alias("t1"),
                                                    F.lit(0).cast("long").alias("k1"), "fp")
    large = _tabled(sized.where(F.col("n") > LIMIT), ["t0", "k0"], 1, radius)
    keys = ["t0", "k0", "t1", "k1"]
    return (small.unionByName(large).select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(_linker(radius), "src long, dst long"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    radius: int = 2) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id reachable by links.

    Null, empty and blank texts have fingerprint zero and link like any other. Null ids take part
    but name a component only if it has no other id. Repeated rows share their component. An
    empty table gives an empty result; other columns are ignored.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    own = rows.groupBy("fp").agg(F.min("id").alias("least"))
    linked = components(links(own.select("fp"), radius)).withColumnsRenamed({"node": "fp", "component": "root"})
    members = own.join(linked, "fp")
    # written, so the rows of a large component needn't meet in one task by their root
    roots = materialise(members.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    named = members.join(roots, "root").select("fp", F.col("component_id").alias("wider"))
    # written, so adaptive execution can split the rows of a fingerprint that many texts have
    found = materialise(own.join(named, "fp", "left").select("fp", F.coalesce("wider", "least").alias("component_id")), "named")
    release(roots)
    return rows.join(found, "fp").select("id", "fp", "component_id")


#: Seeds of the fingerprints that propose near copies for the exact check.
SEEDS = (42, 43, 44, 45, 46)


def word_fingerprints(text: str | None, seeds: tuple[int, ...] = SEEDS) -> list[int]:
    """Unsigned SimHashes of the set of distinct words, one for each seed; A-Z in lower case."""
    words = sorted(set((text or "").encode("utf-8", "surrogatepass").lower().split()))
    if not words:
        return [0] * len(seeds)
    out = []
    for seed in seeds:
        hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], "<u8")
        ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(((2 * ones > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum()))
    return out


def shingles(text: str | None, width: int = 5) -> set[bytes]:
    """The distinct ``width``-word shingles; fewer words make one, none make none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return set()
    return {b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


#: Words of 64 bits in the sketch that bounds how many shingles two texts share.
SKETCH = 16
#: Bits of the table of common shingles, and the texts of a window of ``_WINDOW`` shingles that make one common.
COMMON_BITS = 1 << 23
COMMON = 4
_WINDOW = 1 << 21


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Ascending distinct hashes of the ``width``-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *stops[: -width].tolist()]
    return np.unique(np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts, (stops[width - 1:] - 1).tolist(), strict=True)], np.uint64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the hashes by their low bits. Two sketches differ in at most as many bits as the sets in elements."""
    odd = np.bincount((hashes % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20) & np.uint64(COMMON_BITS - 1)).astype(np.int64)


def common(texts: DataFrame, width: int) -> np.ndarray:
    """A bit for each slot that holds a common shingle. It only decides the order of shingles, which is the same for
    all texts, so what is missed or shares a slot costs time and no link."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, size = np.zeros(COMMON_BITS, bool), [], 0
        for batch in batches(frames, 200):
            for text in batch.column(1):
                held.append(shingle_hashes(text.as_py(), width))
                size += len(held[-1])
                if size >= _WINDOW:
                    mark(bits, held)
                    held, size = [], 0
        if held:
            mark(bits, held)
        words = np.packbits(bits, bitorder="little").view("<i8")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words[at], pa.int64())], names=["word", "bits"])

    def mark(bits: np.ndarray, held: list[np.ndarray]) -> None:
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        bits[_slot(hashes[counts >= COMMON])] = True

    found = texts.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(COMMON_BITS // 64, "<i8")
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return words.view(np.uint8)


def _heads(width: int, similarity: float, often):
    """(id, number of shingles, prefix, sketch), common shingles last. Of two sets with a Jaccard similarity of
    ``similarity`` both prefixes, the first n - ceil(similarity * n) + 1 hashes, hold their first common one; one more
    allows for a collision."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = often.value
        for batch in batches(frames, 200):
            ids, sizes, heads, sketches = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = shingle_hashes(text.as_py(), width)
                if n := len(hashes):
                    ids.append(i)
                    sizes.append(n)
                    slot = _slot(hashes)
                    last = (bits[slot >> 3] >> (slot & 7) & 1).astype(bool)
                    ordered = np.concatenate([hashes[~last], hashes[last]])
                    heads.append(ordered[:n - math.ceil(similarity * n - 1e-9) + 2].view(np.int64))
                    sketches.append(sketch(hashes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(heads, pa.list_(pa.int64())),
                 pa.array(sketches, pa.list_(pa.int64()))], names=["node", "n", "head", "sketch"])

    return run


def _shared(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by the first column, those whose value another row has too."""
    held, before = None, False  # the last row, and whether it equals its predecessor
    for batch in frames:
        if batch.num_rows:
            names = batch.schema.names
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            rows = rows if held is None else np.concatenate([held, rows])
            same = rows[1:, 0] == rows[:-1, 0]
            found = rows[:-1][np.r_[before, same][:-1] | same]
            before = bool(same[-1]) if len(same) else before
            held = rows[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found.T], names=names)
    if before:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held.T], names=names)


def _possible(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows (label, size, place, node, sketch) of a bucket may be a link to another component. No link is missed
    in the bucket of the two prefixes' first common shingle: after it, sets share no more than is left of the shorter
    rest, and never more than their sketches allow."""
    total = a[:, 1, None] + b[None, :, 1]
    least = np.ceil(similarity / (1 + similarity) * total - 1e-9).astype(np.int64) - 1
    left = np.minimum((a[:, 1] - a[:, 2])[:, None], (b[:, 1] - b[:, 2])[None, :])
    found = (left >= least) & (a[:, 0, None] != b[None, :, 0])
    x, y = np.nonzero(found)
    if 4 * len(x) < found.size:
        apart = np.bitwise_count(a[x, 4:].view(np.uint64) ^ b[y, 4:].view(np.uint64)).sum(axis=1, dtype=np.int64)
        found[x, y] = total[x, y] - apart >= 2 * least[x, y]
        return found
    apart = np.zeros(found.shape, np.int64)
    for k in range(4, a.shape[1]):
        apart += np.bitwise_count(a[:, k, None].view(np.uint64) ^ b[None, :, k].view(np.uint64))
    return found & (total - apart >= 2 * least)


def _centres(rows: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """Of each row an edge to the possible partner that has the most, among rows of like size."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1]))]
    for i in range(0, len(rows), 2 * _BLOCK):
        own = rows[i:i + 2 * _BLOCK]
        found = _possible(own, own, similarity)
        some = found.any(axis=1)
        rank = np.lexsort((own[:, 3], -found.sum(axis=1))).argsort()
        centre = np.where(found, rank[None, :], len(own)).argmin(axis=1)
        yield np.stack([own[some, 3], own[centre[some], 3]])


def _pairs(rows: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """All possible edges; none is looked for inside the largest component of the bucket."""
    labels, which, sizes = np.unique(rows[:, 0], return_inverse=True, return_counts=True)
    last = which == sizes.argmax()
    rows, few = np.concatenate([rows[~last], rows[last]]), int((~last).sum())
    for i in range(0, few, _BLOCK):
        stop = min(i + _BLOCK, few)
        for j in range(i, len(rows), _BLOCK):
            x, y = np.nonzero(_possible(rows[i:stop], rows[j:j + _BLOCK], similarity))
            x, y = x + i, y + j
            yield np.stack([rows[x[x < y], 3], rows[y[x < y], 3]])


def _meetings(similarity: float, propose):
    """Over rows (shingle, label, size, place, node, sketch) sorted by shingle: edges between different labels."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5 + SKETCH), np.int64)

        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            edges, size = [], 0
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(rows)], strict=True):
                if (rows[s:e, 1] != rows[s, 1]).any():
                    for made in propose(rows[s:e, 1:], similarity):
                        edges.append(made)
                        size += made.shape[1]
                        if size > 1 << 16:
                            yield batch_of(edges)
                            edges, size = [], 0
            if edges:
                yield batch_of(edges)

        def batch_of(edges: list[np.ndarray]) -> pa.RecordBatch:
            both = np.sort(np.concatenate(edges, axis=1), axis=0)
            both = np.unique(both, axis=1) if both.shape[1] else both
            return pa.RecordBatch.from_arrays([pa.array(both[1], pa.int64()), pa.array(both[0], pa.int64())], names=["src", "dst"])

        for batch in frames:
            if batch.num_rows:
                columns = [c.to_numpy()[:, None] for c in batch.columns[:5]]
                columns.append(batch.column(5).flatten().to_numpy().reshape(-1, SKETCH))
                rows = np.concatenate([held, np.concatenate(columns, axis=1)])
                other = np.flatnonzero(rows[:, 0] != rows[-1, 0])
                last = int(other[-1]) + 1 if len(other) else 0
                if last:
                    yield from out(rows[:last])
                held = rows[last:]
        if len(held):
            yield from out(held)

    return run


def _stars(prints: np.ndarray, nodes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each node's edge to the neighbour with the most neighbours (ties: the smaller node), so near
    copies meet the text they were copied from. Neighbours differ in ``most`` bits or fewer."""
    degree = np.zeros(len(nodes), np.int64)
    centre = np.zeros(len(nodes), np.int64)
    for finish in (False, True):
        rank = np.argsort(np.argsort(np.lexsort((nodes, -degree)), kind="stable"), kind="stable") if finish else None
        for i in range(0, len(nodes), _BLOCK):
            apart = np.zeros((len(prints[i:i + _BLOCK]), len(nodes)), np.int16)
            for k in range(prints.shape[1]):
                apart += np.bitwise_count(prints[i:i + _BLOCK, k, None] ^ prints[None, :, k])
            near = apart <= most
            if finish:
                centre[i:i + _BLOCK] = np.where(near, rank[None, :], len(nodes)).argmin(axis=1)
            else:
                degree[i:i + _BLOCK] = near.sum(axis=1)
    moved = nodes != nodes[centre]
    return nodes[moved], nodes[centre][moved]


def _proposer(most: int, prints: int):
    """Over rows sorted by bucket (four key columns, the prints, the node): star edges."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5 + prints), np.int64)

        def out(rows: np.ndarray) -> pa.RecordBatch:
            edges = [np.zeros((2, 0), np.int64)]
            if len(rows):
                cut = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
                starts, stops = np.r_[0, cut], np.r_[cut, len(rows)]
                for s, e in zip(starts.tolist(), stops.tolist(), strict=True):
                    own = rows[s:e, 4:]
                    if e - s > LIMIT:  # like prints side by side; what their blocks part, the prefix filter finds
                        own = own[np.lexsort(own.T[::-1])]
                    for i in range(0, e - s, LIMIT):
                        block = own[i:i + LIMIT]
                        if len(block) > 1:
                            edges.append(np.stack(_stars(block[:, :-1].copy().view(np.uint64), block[:, -1], most)))
            src, dst = np.concatenate(edges, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

        for batch in frames:
            if batch.num_rows:
                rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
                other = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
                last = int(other[-1]) + 1 if len(other) else 0
                if last:
                    yield out(rows[:last])
                held = rows[last:]
        yield out(held)

    return run


def _verify(width: int, similarity: float):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, 100):
            known: dict[int, set[bytes]] = {}  # a centre's shingles serve its neighbours
            keep = []
            for src, dst, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = shingles(x, width)
                b = known.get(dst)
                if b is None:
                    known.clear()
                    b = known[dst] = shingles(y, width)
                keep.append(len(a & b) >= similarity * len(a | b))
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                similarity: float = 0.8, radius: int = 3, most: int = 50) -> DataFrame:
    """(node, component) over the ids of texts in a group of near copies, component the smallest id.

    A group is a connected component of the pairs whose ``width``-word shingles have a Jaccard
    similarity of ``similarity`` or more. Every candidate is compared by its shingles. First
    SimHashes of the word set, one for each of ``SEEDS``, propose: covering tables of each bring together every pair
    within ``radius`` bits of one of them, and pairs within ``most`` bits over all of them become
    candidates, each text with the most central one around it. Then a prefix filter finds all links
    that are left: texts meet by the shingles of their prefixes, first each with the most central
    one, then every pair whose components still differ and that sizes, places and sketches do not
    rule out. Null ids and texts without words are never in a group.
    """
    names = [f"f{k}" for k in range(len(SEEDS))]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, 500):
            made = np.array([word_fingerprints(x.as_py()) for x in batch.column(1)], np.uint64).reshape(-1, len(SEEDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(made[:, k].copy().view(np.int64), pa.int64()) for k in range(len(SEEDS)))],
                names=["id", *names])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where(
        "id is not null")
    rows = materialise(texts.mapInArrow(run, "id long, " + ", ".join(f"{n} long" for n in names)), "prints")
    # equal prints: one node, to which the others are candidates themselves
    nodes = rows.where(" or ".join(f"{n} <> 0" for n in names)).groupBy(*names).agg(F.min("id").alias("node"))
    alike = rows.join(nodes, names).where("id <> node").select(F.col("id").alias("src"), F.col("node").alias("dst"))
    cover = masks(radius, 0)
    tables = F.array(*[F.struct(F.lit(k * len(cover) + t).cast("long").alias("t"), F.col(n).bitwiseAND(F.lit(m)).alias("k"))
                       for k, n in enumerate(names) for t, m in enumerate(cover)])
    # only keys and nodes are shuffled for all tables; prints join the few rows that share a bucket
    first = nodes.select("node", F.explode(tables).alias("x")).select(
        F.col("x.t").alias("t0"), F.col("x.k").alias("k0"), "node")
    sizes = first.groupBy("t0", "k0").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = first.join(sizes, ["t0", "k0"]).join(nodes, "node")
    none = F.lit(0).cast("long")
    small = sized.where(F.col("n") <= LIMIT).select("t0", "k0", none.alias("t1"), none.alias("k1"), *names, "node")
    printed = F.element_at(F.array(*names), F.floor(F.col("t0") / len(cover)).cast("int") + 1)
    inner = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), printed.bitwiseAND(F.lit(m)).alias("k"))
                      for t, m in enumerate(masks(radius, 1))])
    large = (sized.where(F.col("n") > LIMIT).select("t0", "k0", *names, "node", F.explode(inner).alias("x"))
             .select("t0", "k0", F.col("x.t").alias("t1"), F.col("x.k").alias("k1"), *names, "node"))
    keys = ["t0", "k0", "t1", "k1"]
    proposed = (small.unionByName(large).repartition(*keys).sortWithinPartitions(*keys)
                .mapInArrow(_proposer(most, len(names)), "src long, dst long"))
    edges = materialise(proposed.unionByName(alike).distinct(), "candidates")
    often = docs.sparkSession.sparkContext.broadcast(common(texts, width))
    heads = materialise(texts.mapInArrow(_heads(width, similarity, often), "node long, n long, head array<long>, sketch array<long>"),
                        "heads")
    met = materialise(
        heads.select("node", "n", F.posexplode("head").alias("place", "h"))
        .select("h", F.col("n").bitwiseOR(F.shiftleft(F.col("place").cast("long"), 32)).alias("at"), "node")
        .repartition("h").sortWithinPartitions("h").mapInArrow(_shared, "h long, at long, node long"), "meetings")
    met = met.select("h", "node", F.col("at").bitwiseAND((1 << 32) - 1).alias("n"), F.shiftright("at", 32).alias("place"))
    # the texts that any round compares are shuffled out of the others once
    wanted = met.select("node").union(edges.select("src")).union(edges.select("dst")).distinct()
    members = materialise(texts.join(wanted.toDF("id"), "id"), "compared")
    sketches = heads.select("node", "sketch")

    def verified(pairs: DataFrame) -> DataFrame:
        return materialise(
            pairs.join(members.toDF("src", "x"), "src").join(members.toDF("dst", "y"), "dst").select("src", "dst", "x", "y")
            .mapInArrow(_verify(width, similarity), "src long, dst long"), "verified")

    tried, linked = edges, verified(edges)
    known = components(linked)
    for propose in (_centres, _pairs):
        labelled = met.join(known, "node", "left").join(sketches, "node").select(
            "h", F.coalesce("component", "node").alias("label"), "n", "place", "node", "sketch")
        more = (labelled.repartition("h").sortWithinPartitions("h")
                .mapInArrow(_meetings(similarity, propose), "src long, dst long").distinct())
        both = tried.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        more = materialise(more.join(both, ["src", "dst"], "left_anti"), "candidates")
        found = verified(more)
        tried, linked = tried.union(more), linked.union(found)
        if not found.isEmpty():
            known = components(linked)
    return known


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
             similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """``docs`` with one row of every group of near copies, that with the smallest id.

    All columns stay, whatever their names. Rows outside any group and rows with a null id stay, and
    so does every row whose id isn't unique, since a decision on an id can't tell its rows apart. Null,
    empty and blank texts are in no group; texts are compared whole; an empty table stays empty.
    """
    own = numbered(docs)
    key = f"c{docs.columns.index(id_col)}"
    gone = near_copies(docs, id_col, text_col, width, similarity, radius).where("node <> component").select("node")
    repeated = own.groupBy(F.col(key).cast("long").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    drop = materialise(gone.join(repeated, "node", "left_anti"), "dropped")
    return own.join(drop, F.col(key).cast("long") == F.col("node"), "left_anti").toDF(*docs.columns)
