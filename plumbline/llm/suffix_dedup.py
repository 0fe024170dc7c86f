"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes when it lies in a string of ``length`` bytes that starts anywhere else too. Comparing
all suffixes of a corpus in one place doesn't scale, so equal strings are first brought together:

1. Every string of ``length`` bytes has an anchor, the position of the least hash among the
   ``gram``-byte strings inside (a minimizer; it depends on the string alone, so equal strings have
   equal anchors). Neighbouring starts share anchors and form segments, about one in
   (length - gram) / 2 bytes. Only a segment's hashes are shuffled.
2. An anchor found once decides all its strings: none repeats. Of segments that are equal (by a
   cryptographic digest of their bytes and the anchor's place) all strings repeat; one stands for them.
3. The distinct segments of an anchor are compared by a suffix
   sort: a mergesort that compares suffixes by the longest common
   extension, found by binary search over prefix polynomial hashes. Neighbours in the order that
   agree in ``length`` bytes by hash are verified byte by byte.
4. Groups of more than ``GROUP`` distinct segments are split before they are sorted: into pieces of
   ``BLOCKS`` strings with like places of the anchor, dealt out by the bytes that these strings have in common (equal
   strings have them all). Groups that are still too large are split once more, to single strings;
   there a group holds equal strings only, and their bytes are compared in the aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches, materialise, release

LENGTH = 400
GRAM = 128
#: Distinct segments of an anchor that one task sorts at most.
GROUP = 2000
#: Strings of a piece when a group is split, first and again.
BLOCKS = (16, 1)
#: Bytes of a text that are hashed at a time; a longer text goes in overlapping slices.
SLICE = 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Hashes:
    """Prefix polynomial hashes modulo 2**64 of one block of bytes."""

    up = _powers(_BASE, 1)
    down = _powers(_INVERSE, 1)

    def __init__(self, data: np.ndarray) -> None:
        if len(data) >= len(_Hashes.up):
            _Hashes.up = _powers(_BASE, len(data) + 1)
            _Hashes.down = _powers(_INVERSE, len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _Hashes.up[: len(data)], out=self.prefix[1:])

    def grams(self, n: int) -> np.ndarray:
        """Mixed hashes of all n-byte strings."""
        raw = (self.prefix[n:] - self.prefix[:-n]) * _Hashes.down[: len(self.prefix) - n]
        return _mix(raw)

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.prefix[start + size] - self.prefix[start]) * _Hashes.down[start]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_PLACE = np.uint64((1 << 23) - 1)


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first start, number of starts, anchor place, anchor hash) of one text's segments."""
    found = []
    width = length - gram + 1
    for at in range(0, max(0, len(data) - length + 1), SLICE):
        part = data[at:at + SLICE + length - 1]
        mixed = _Hashes(part).grams(gram)
        # the hash above, the place below: the leftmost of equal hashes is the least
        keys = (mixed & ~_PLACE) | np.arange(len(mixed), dtype=np.uint64)
        n = len(keys) - width + 1
        least = _sliding_min(keys, width)[:n]
        place = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        found.append((first + at, np.diff(np.r_[first, n]), place[first] + at, mixed[place[first]]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window, from running minima of blocks in both directions."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1:n])


def suffix_order(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes by (group, first ``depth`` bytes); every suffix has as many.

    A bottom-up mergesort inside the groups: two sorted runs merge by finding each suffix's place
    in the other run, a binary search whose comparisons are common extensions by hash, themselves
    a binary search. Returns the order and, for each suffix but the first, its common extension
    with the one before (0 across groups).
    """
    hashes = _Hashes(data)
    n = len(starts)
    order = np.argsort(group, kind="stable")
    of = group[order]  # the group of each place; merging never changes it
    edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    number = np.cumsum(np.r_[True, of[1:] != of[:-1]]) - 1
    opens, closes = edge[number], np.r_[edge[1:], n][number]
    at = np.arange(n)

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.full(len(a), depth, np.int64)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = hashes.of(a, middle) == hashes.of(b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
            high = np.maximum(low, high)
        return low

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before y; equal ones as ``ties`` says."""
        ext = common(x, y)
        step = np.minimum(ext, depth - 1)
        return np.where(ext >= depth, ties, data[x + step] < data[y + step])

    size = 1
    while size < n:
        middle_of = at // (2 * size) * (2 * size) + size
        merging = middle_of < n
        border = np.minimum(middle_of, n - 1)
        merging &= (of[border] == of) & (of[border - 1] == of)
        left = at < border
        low = np.where(left, border, np.maximum(border - size, opens))
        high = np.where(left, np.minimum(border + size, closes), border)
        # equal suffixes keep the left run's first, so a tie is decided one way on either side
        active = np.flatnonzero(merging & (low < high))
        while len(active):
            middle = (low[active] + high[active]) >> 1
            below = before(starts[order[middle]], starts[order[active]], ~left[active])
            low[active[below]] = middle[below] + 1
            high[active[~below]] = middle[~below]
            active = active[low[active] < high[active]]
        place = np.where(merging, np.where(left, at + low - border, low + at - border), at)
        merged = np.empty(n, np.int64)
        merged[place] = order
        order = merged
        size *= 2
    ext = common(starts[order[:-1]], starts[order[1:]])
    return order, np.where(of[:-1] == of[1:], ext, 0)


def repeated(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes share their first ``depth`` bytes with another one of their group."""
    out = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return out
    order, ext = suffix_order(data, starts, group, depth)
    for i in np.flatnonzero(ext >= depth).tolist():  # verified, so a hash collision can't remove text
        x, y = starts[order[i]], starts[order[i + 1]]
        if np.array_equal(data[x:x + depth], data[y:y + depth]):
            out[order[i]] = out[order[i + 1]] = True
    return out


_SEGMENT = "array<struct<start:int,n:int,place:int,anchor:long,d1:long,d2:long>>"
_SEGMENT_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("place", pa.int32()),
                                     ("anchor", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())]))


def _cutter(length: int, gram: int):
    """Texts, compressed, with their segments."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6).compress
        for batch in batches(frames, 200):
            packed, offsets, fields = [], [0], [[] for _ in range(6)]
            for x in batch.column(1):
                raw = (x.as_py() or "").encode("utf-8", "surrogatepass")
                packed.append(pack(raw))
                start, n, place, anchor = segments(np.frombuffer(raw, np.uint8), length, gram)
                # what makes two segments equal: their bytes and the anchor's place in them
                digests = b"".join(
                    hashlib.blake2b(raw[s:s + k + length - 1], digest_size=16, salt=(p - s).to_bytes(4, "little")).digest()
                    for s, k, p in zip(start.tolist(), n.tolist(), place.tolist(), strict=True))
                d = np.frombuffer(digests, "<i8").reshape(-1, 2)
                for f, v in zip(fields, (start, n, place - start, anchor.view(np.int64), d[:, 0], d[:, 1]), strict=True):
                    f.append(v)
                offsets.append(offsets[-1] + len(start))
            columns = [np.concatenate(f) if f else np.zeros(0, np.int64) for f in fields]
            struct = pa.StructArray.from_arrays(
                [pa.array(c, t.type) for c, t in zip(columns, _SEGMENT_ARROW.value_type, strict=True)],
                fields=list(_SEGMENT_ARROW.value_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct).cast(_SEGMENT_ARROW)],
                names=["id", "packed", "segments"])

    return run


def _quote(length: int):
    """The bytes of the segments that a text lends to the comparison."""
    names = ["g1", "g2", "d1", "d2", "c", "k", "n", "place"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches(frames, 50):
            rows, cut = [], []
            for packed, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = unpack(packed)
                rows += wanted
                cut += [raw[w["start"]:w["start"] + w["n"] + length - 1] for w in wanted]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[x] for r in rows], pa.int64()) for x in names),
                                              pa.array(cut, pa.binary())], names=[*names, "bytes"])

    return run


#: A class of equal segments or pieces: its group and its digest.
_KEY = ["g1", "g2", "d1", "d2"]
_VERDICT = "g1 long, g2 long, d1 long, d2 long, spans array<struct<start:int,stop:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _verdicts(keys: np.ndarray, owner: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Runs of consecutive starts ``at`` of each class (row of ``keys``) as spans of starts."""
    cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(at) != 1)) + 1 if len(at) else np.zeros(0, np.int64)
    first, last = np.r_[0, cut][: max(len(at), 0)] if len(at) else cut, np.r_[cut, len(at)] - 1 if len(at) else cut
    spans: dict[int, list] = {}
    for f, e in zip(first.tolist(), last.tolist(), strict=True):
        spans.setdefault(int(owner[f]), []).append({"start": int(at[f]), "stop": int(at[e]) + 1})
    rows = list(spans)
    return pa.RecordBatch.from_arrays([*(pa.array(keys[rows, j] if rows else [], pa.int64()) for j in range(4)),
                                       pa.array([spans[r] for r in rows], _SPANS)], names=[*_KEY, "spans"])


def _sorter(length: int):
    """Suffix-sort the groups of rows that are sorted by group; some groups at a time."""

    def judge(rows: list[dict]) -> pa.RecordBatch:
        keys = np.array([[r[k] for k in _KEY] for r in rows], np.int64).reshape(-1, 4)
        sizes = np.array([len(r["bytes"]) for r in rows], np.int64)
        n = np.array([r["n"] for r in rows], np.int64)
        base = np.r_[0, np.cumsum(sizes)[:-1]] if len(rows) else sizes
        owner = np.repeat(np.arange(len(rows)), n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        # equal strings have their anchor at the same place, so only those are compared
        anchors = np.unique(keys[:, :2], axis=0, return_inverse=True)[1].ravel()
        place = np.array([r["place"] for r in rows], np.int64)
        group = anchors[owner] * (1 << 20) + (place[owner] - at)
        data = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
        found = repeated(data, base[owner] + at, group, length)
        found &= np.array([r["c"] == 1 for r in rows], bool)[owner]
        return _verdicts(keys, owner[found], at[found])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches(frames, 2000):
            held += batch.to_pylist()
            last = next((i for i in range(len(held) - 1, 0, -1)
                         if (held[i]["g1"], held[i]["g2"]) != (held[i - 1]["g1"], held[i - 1]["g2"])), 0)
            if last:
                yield judge(held[:last])
                held = held[last:]
        if held:
            yield judge(held)

    return run


_PARENT = ["up_g1", "up_g2", "up_d1", "up_d2"]
_PIECE = ", ".join(f"{c} long" for c in [*_PARENT, "at", *_KEY, "c", "n", "place"]) + ", bytes binary"


def _pieces(length: int, block: int):
    """Segments, cut into pieces whose strings have the anchor at places of one block of ``block``; a piece's
    group is the segment's group, the block and the bytes that any string of the block has around the anchor."""
    names = [x.split()[0] for x in _PIECE.split(", ")]

    def digest(data: bytes, *salt: int) -> list[int]:
        head = b"".join(x.to_bytes(8, "little", signed=True) for x in salt)
        return np.frombuffer(hashlib.blake2b(head + data, digest_size=16).digest(), "<i8").tolist()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, 50):
            rows = []
            for r in batch.to_pylist():
                at = 0
                while at < r["n"]:
                    which = (r["place"] - at) // block
                    stop = min(r["n"], r["place"] - which * block + 1)
                    own = r["bytes"][at:stop - 1 + length]
                    place = r["place"] - at
                    first = r["place"] - which * block
                    rows.append((*(r[k] for k in _KEY), at, *digest(r["bytes"][first:first - block + 1 + length], r["g1"], r["g2"], which),
                                 *digest(own, place), r["c"], stop - at, place, own))
                    at = stop
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], names=names)

    return run


def _copies(classes: DataFrame) -> DataFrame:
    """All strings of a class found more than once repeat."""
    return classes.where("c > 1").select(*_KEY, F.array(F.struct(
        F.lit(0).alias("start"), F.col("n").cast("int").alias("stop"))).alias("spans"))


def _judge(texts: Callable[[DataFrame], DataFrame], classes: DataFrame, length: int, most: int, blocks: tuple[int, ...]) -> DataFrame:
    """Verdicts on all classes (``_KEY``, c, n and what ``texts`` needs): copies, and what a sort of each group with several
    classes finds. ``texts`` adds bytes to classes with a group size k."""
    kinds = materialise(classes.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "group-sizes")
    split = bool(blocks) and not kinds.where(F.col("k") > most).isEmpty()
    quoted = texts(classes.join(kinds, ["g1", "g2"]))
    if split:
        quoted = materialise(quoted, "quoted")
    # sorting takes far longer than its bytes suggest, so small partitions aren't put together
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = quoted.where(F.col("k") <= most) if split else quoted
    found = _copies(classes).unionByName(small.repartition(tasks, "g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(_sorter(length), _VERDICT))
    if not split:
        return found
    pieces = materialise(quoted.where(F.col("k") > most).mapInArrow(_pieces(length, blocks[0]), _PIECE), "pieces")
    same = F.when(F.min("bytes") == F.max("bytes"), F.min("bytes")).otherwise(
        F.raise_error(F.lit("two strings share one digest")).cast("binary"))
    own = materialise(pieces.groupBy(*_KEY).agg(
        F.sum("c").alias("c"), F.min("n").alias("n"), F.min("place").alias("place"), same.alias("bytes")), "piece-classes")
    verdicts = materialise(_judge(lambda x: x.select(*_KEY, "c", "k", "n", "place", "bytes"), own, length, most, blocks[1:]), "piece-verdicts")
    back = (pieces.select(*_PARENT, "at", *_KEY).join(verdicts, _KEY).select(*_PARENT, "at", F.explode("spans").alias("x"))
            .where("x.start < x.stop").groupBy(*_PARENT).agg(F.collect_list(F.struct(
                (F.col("at") + F.col("x.start")).cast("int").alias("start"),
                (F.col("at") + F.col("x.stop")).cast("int").alias("stop"))).alias("spans")))
    return found.unionByName(back.toDF(*_KEY, "spans"))


def _remover(length: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches(frames, 200):
            sizes, removed, counts, kept = [], [], [], []
            for packed, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = unpack(packed)
                spans = merge_spans([(m["start"], m["stop"] + length - 1) for m in marks or []])
                rest, at = [], 0
                for s, e in spans:
                    rest.append(raw[at:s])
                    at = e
                left = b"".join([*rest, raw[at:]])
                sizes.append(len(raw))
                removed.append(len(raw) - len(left))
                counts.append(len(spans))
                kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, most: int = GROUP) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) for every row.

    Strings of ``length`` UTF-8 bytes are judged on the input; a string that repeats goes in every
    place, first ones too, and overlaps count. Texts shorter than ``length`` (null and empty ones
    too) stay whole. Repeated rows are copies of each other, so their long texts go entirely. An
    empty table gives an empty result; other columns are ignored.
    """
    if not 8 <= gram < length:
        raise ValueError("gram must be from 8 to length - 1")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = materialise(
        docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
        .mapInArrow(_cutter(length, gram), f"id {kind}, packed binary, segments {_SEGMENT}")
        .withColumn("row", F.monotonically_increasing_id()), "segments")
    found = texts.select("row", F.explode("segments").alias("s")).select(
        "row", "s.start", "s.n", "s.place", F.col("s.anchor").alias("g1"), "s.d1", "s.d2")
    # the small sides of joins are written tables, so adaptive execution can split a hot anchor's rows
    several = materialise(found.groupBy("g1").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("g1"), "repeated-anchors")
    # these rows are small and quickly made: a file for every four partitions spares the shared storage
    files = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    multi = materialise(found.join(several, "g1").coalesce(files), "shared-anchors")
    release(several)
    classes = materialise(multi.groupBy("g1", "d1", "d2").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("row", "start", "n", "place")).alias("first")).select(
            "g1", F.lit(0).cast("long").alias("g2"), "d1", "d2", "c", F.col("first.n").alias("n"), "first").coalesce(files), "classes")

    def quotes(x: DataFrame) -> DataFrame:
        """A class's bytes come from its first text, which lends all that is wanted of it at once."""
        wanted = x.groupBy("first.row").agg(F.collect_list(F.struct(
            *_KEY, "c", "k", "first.start", "first.n", "first.place")).alias("wanted"))
        return texts.select("row", "packed").join(wanted, "row").select("packed", "wanted").mapInArrow(
            _quote(length), ", ".join(f"{c} long" for c in [*_KEY, "c", "k", "n", "place"]) + ", bytes binary")

    verdicts = _judge(quotes, classes, length, most, BLOCKS)
    marks = (multi.join(verdicts.drop("g2"), ["g1", "d1", "d2"]).select("row", "start", F.explode("spans").alias("x"))
             .groupBy("row").agg(F.collect_list(F.struct(
                 (F.col("start") + F.col("x.start")).alias("start"), (F.col("start") + F.col("x.stop")).alias("stop"))).alias("marks")))
    return (texts.select("row", "id", "packed").join(marks, "row", "left").select("id", "packed", "marks")
            .mapInArrow(_remover(length), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"))
