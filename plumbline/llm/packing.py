"""Bounded-space online packing of documents into fixed-size token sequences.

Each partition is one pass with a fixed number of open windows. A document longer than a window
fills whole windows first. Its rest goes into the open window that it fits best; when none fits,
the fullest window is topped up with the beginning of the rest and emitted, and the remainder is
placed again. When a partition ends, its open windows are merged into whole ones, so at most one
part-filled window is left; the leftovers of all partitions are merged in groups, and the last
window of a group is cut into lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches, materialise

WINDOW = 2048
OPEN_WINDOWS = 64
#: Leftover windows that one task merges.
GROUP = 512
#: Chunks that a worker remembers.
_WORDS = 250_000
_ENCODERS: dict = {}

PIECE = ("id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


class WordIds:
    """Token ids of whole texts as bytes (little-endian unsigned 32-bit), by a ``tokenizers`` file.

    Latin-1 texts are split at white space, each lower-cased chunk is cut by the file's own
    pattern and merged once, and remembered; the merges of all new pieces of a batch run together
    as array operations, in the rank order of the file. Other texts go through the tokenizer
    itself. Both give the tokenizer's ids. The memory is bounded: it starts anew when full.

    A special token's string in a text gives that token's id, as the tokenizer does by default; with
    ``special_as_text`` it is ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [
            t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        model = json.loads(self.tokenizer.to_str())["model"]
        vocab = model["vocab"]
        letters = _byte_letters()
        end = model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab["".join(m)] for m in pairs], np.int64)
        self.table = _Ranks(left, right, made)
        self.chunks, self.pieces = _Store(), _Store()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.chunks.index) > _WORDS:
            self.chunks, self.pieces = _Store(), _Store()
        chunks, number = self.chunks, self.chunks.index.__getitem__
        found: list[np.ndarray | None] = []
        for t in texts:
            if any(x in t for x in self.special):
                found.append(None)
                continue
            try:
                words = t.lower().encode("latin-1").split()
                found.append(np.fromiter(map(number, words), np.int64, len(words)))
            except UnicodeEncodeError:
                found.append(None)
        self._learn(chunks.new())
        rest = iter(self.tokenizer.encode_batch_fast(
            [t for t, f in zip(texts, found, strict=True) if f is None], add_special_tokens=False))
        own = [f for f in found if f is not None]
        flat, sizes = chunks.gather(np.concatenate(own) if own else np.zeros(0, np.int64))
        stops = iter(np.r_[0, np.cumsum(sizes)][np.cumsum([len(f) for f in own])].tolist() if own else [])
        raw, at, out = flat.astype("<u4").tobytes(), 0, []
        for f in found:
            if f is None:
                out.append(np.array(next(rest).ids, "<u4").tobytes())
            else:
                stop = 4 * next(stops)
                out.append(raw[at:stop])
                at = stop
        return out

    def _learn(self, chunks: list[bytes]) -> None:
        if not chunks:
            return
        split = [_SPLIT.findall(c) for c in chunks]
        number = self.pieces.index.__getitem__
        ids = np.fromiter((number(p) for s in split for p in s), np.int64)
        new = self.pieces.new()
        if new:
            self.pieces.add(*self._merge(new))
        flat, sizes = self.pieces.gather(ids)
        stops = np.r_[0, np.cumsum(sizes)][np.cumsum([len(s) for s in split])]
        self.chunks.add(flat, np.diff(stops, prepend=0))

    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after another, and how many each has; in every round each piece
        makes its lowest-ranked merge."""
        data = [p.decode("latin-1").encode() for p in pieces]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(data)), sizes)
        ids = self.inner[flat]
        ids[ends - 1] = self.last[flat[ends - 1]]
        # symbols of finished words move to `done`, so later rounds see only words that still merge
        done_word, done_ids, done_at = [], [], []
        at = np.arange(len(flat))
        while len(ids):
            rank, made = self.table.find(ids[:-1], ids[1:])
            rank = np.where(word[:-1] == word[1:], rank, _NEVER)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, _NEVER], first)
            owner = np.cumsum(np.r_[True, word[1:] != word[:-1]]) - 1
            active = (lowest < _NEVER)[owner]
            if not active.all():
                done_word.append(word[~active])
                done_ids.append(ids[~active])
                done_at.append(at[~active])
            hit = np.flatnonzero((rank == lowest[owner[:-1]]) & (rank < _NEVER)) if len(rank) else np.zeros(0, np.int64)
            # of overlapping hits (a run of one symbol) every second counts, from the left
            if len(hit) > 1:
                run = np.r_[True, np.diff(hit) != 1]
                place = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
                hit = hit[place % 2 == 0]
            ids = ids.copy()
            ids[hit] = made[hit]
            keep = active.copy()
            keep[hit + 1] = False
            ids, word, at = ids[keep], word[keep], at[keep]
        where = np.concatenate(done_at)
        order = np.argsort(where)
        counts = np.bincount(np.concatenate(done_word), minlength=len(data))
        return np.concatenate(done_ids)[order], counts


class _Store:
    """Numbered byte strings with a run of ids each."""

    def __init__(self) -> None:
        self.index: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.flat = np.zeros(1 << 16, np.int64)
        self.stop = np.zeros(1, np.int64)  # end of each run, after a leading zero

    def new(self) -> list[bytes]:
        """Strings that have a number but no ids yet, in order."""
        return list(itertools.islice(reversed(self.index), len(self.index) - len(self.stop) + 1))[::-1]

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        used = self.stop[-1]
        if used + len(flat) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros(max(len(self.flat), len(flat)), np.int64)]
        self.flat[used:used + len(flat)] = flat
        self.stop = np.r_[self.stop, used + np.cumsum(sizes)]

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered strings, one run after another, and the runs' sizes."""
        start = self.stop[numbers]
        sizes = self.stop[numbers + 1] - start
        shift = np.repeat(start - np.r_[0, np.cumsum(sizes)[:-1]], sizes) if len(sizes) else start
        return self.flat[shift + np.arange(len(shift))], sizes


_NEVER = 1 << 40
#: The split pattern of the tokenizer file, for lower-case Latin-1 bytes: contractions, runs of
#: letters, single numerals, runs of anything else but white space.
_SPLIT = re.compile(
    rb"[a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|'(?:s|t|re|ve|m|ll|d)"
    rb"|[^a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe\x09-\x0d\x20\x85\xa0]+")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 for itself, the others by U+0100 and on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


class _Ranks:
    """Ranks of symbol pairs in an open-addressed table of arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        self.bits = 18
        keys = (left << 20) | right
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, _NEVER, np.int64)
        self.made = np.zeros(1 << self.bits, np.int64)
        waiting, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(waiting):
            self.probes += 1
            free = self.keys[slot] == -1
            at, pick = np.unique(slot[free], return_index=True)
            chosen = waiting[free][pick]
            self.keys[at], self.rank[at], self.made[at] = keys[chosen], chosen, made[chosen]
            rest = ~np.isin(waiting, chosen)
            waiting, slot = waiting[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left << 20) | right
        slot = self._slot(keys)
        rank = np.full(len(keys), _NEVER, np.int64)
        made = np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == keys[open_]
            rank[open_[hit]], made[open_[hit]] = self.rank[slot[hit]], self.made[slot[hit]]
            more = ~hit & (there != -1)
            open_, slot = open_[more], (slot[more] + 1) & ((1 << self.bits) - 1)
            if not len(open_):
                break
        return rank, made


class Packer:
    """Windows of one partition; pieces are (doc, start, ids, doc_tokens, owner)."""

    def __init__(self, first_sequence: int, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> None:
        self.window, self.most = window, open_windows
        self.next = first_sequence
        self.open: list[tuple[int, int]] = []  # (room, number), ascending
        self.held: dict[int, list[tuple]] = {}
        self.number = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def place(self, doc: int | None, start: int, ids: bytes, total: int) -> None:
        """Put the piece somewhere, cutting it only at a full window's end."""
        while len(ids) >= 4 * self.window:
            self.emit([(doc, start, ids[: 4 * self.window], total)])
            ids, start = ids[4 * self.window:], start + self.window
        while ids:
            n = len(ids) // 4
            at = bisect_left(self.open, (n, -1))
            if at < len(self.open):  # best fit: least room that is enough
                room, number = self.open.pop(at)
                self.held[number].append((doc, start, ids, total))
                if room == n:
                    self.emit(self.held.pop(number))
                else:
                    insort(self.open, (room - n, number))
                return
            if len(self.open) < self.most:
                self.held[self.number] = [(doc, start, ids, total)]
                insort(self.open, (self.window - n, self.number))
                self.number += 1
                return
            room, number = self.open.pop(0)  # the fullest, topped up
            self.emit([*self.held.pop(number), (doc, start, ids[: 4 * room], total)])
            ids, start = ids[4 * room:], start + room

    def merge(self) -> list[tuple]:
        """Merge the open windows into whole ones, fullest first; the pieces of the last one."""
        pieces = [p for _, number in self.open for p in self.held.pop(number)]
        self.open = []
        current: list[tuple] = []
        room = self.window
        for doc, start, ids, total in pieces:
            while len(ids) // 4 >= room:
                self.emit([*current, (doc, start, ids[: 4 * room], total)])
                ids, start = ids[4 * room:], start + room
                current, room = [], self.window
            if ids:
                current.append((doc, start, ids, total))
                room -= len(ids) // 4
        return current

    def finish(self, pieces: list[tuple]) -> None:
        """Cut the last pieces into sequences whose lengths are powers of two."""
        left = sum(len(p[2]) for p in pieces) // 4
        pieces = list(pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            taken = []
            while size:
                doc, start, ids, total = pieces.pop(0)
                n = min(size, len(ids) // 4)
                taken.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    pieces.insert(0, (doc, start + n, ids[4 * n:], total))
                size -= n
            self.emit(taken)


_FIELDS = [pa.field(x.split()[0], pa.int64()) for x in PIECE.split(", ")]
_LEFT = pa.field("left", pa.binary())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 8
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.binary())],
                                      schema=pa.schema([*_FIELDS, _LEFT]))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
         window: int = WINDOW, open_windows: int = OPEN_WINDOWS, special_as_text: bool = False) -> DataFrame:
    """Pack every whole text, followed by ``end_id``; one row per piece (columns of ``PIECE``).

    A null or empty text is the single token ``end_id``. A long text is cut at window ends.
    Repeated rows are packed again. No sequence needs padding to ``window``: all are full or have
    a power of two as their length. ``sequence_id`` is unique over all partitions. An empty table
    gives an empty result. Each partition keeps ``open_windows`` windows in memory, no more.
    """
    tail = np.array([end_id], "<u4").tobytes()

    def local(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = tokenizer_path, special_as_text
        encode = _ENCODERS.get(which) or _ENCODERS.setdefault(which, WordIds(*which))
        packer = Packer(TaskContext.get().partitionId() << 32, window, open_windows)
        for batch in batches(frames, 500):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                ids += tail
                packer.place(doc, 0, ids, len(ids) // 4)
            if packer.rows:
                yield _batch([(*r, None) for r in packer.rows])
                packer.rows = []
        last = packer.merge()
        yield _batch([(*r, None) for r in packer.rows]
                     + [(doc, start, len(ids) // 4, None, total, packer.next, None, ids) for doc, start, ids, total in last])

    first = materialise(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
                        .mapInArrow(local, f"{PIECE}, left binary"), "packed")
    left = first.where("left is not null")
    whole = first.where("left is null").drop("left")
    # a leftover window has fewer than `window` tokens and all its pieces share a sequence_id
    by = F.shiftright("sequence_id", 32)
    grouped = left.withColumn("group", F.floor(by / F.lit(GROUP)))
    merged = grouped.groupBy("group").applyInArrow(_merger(window), PIECE)
    return whole.unionByName(merged)


def _merger(window: int) -> Callable:
    def merge(key: tuple, part: pa.Table) -> pa.Table:
        rows = sorted(zip(*(part.column(c).to_pylist() for c in ("sequence_id", "id", "start", "left", "doc_tokens")),
                          strict=True), key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]))
        packer = Packer((1 << 62) | (key[0].as_py() << 32), window)
        packer.held = {0: [(doc, start, ids, total) for _, doc, start, ids, total in rows]}
        packer.open = [(0, 0)]
        packer.finish(packer.merge())
        return pa.Table.from_batches([_batch([(*r, None) for r in packer.rows])]).drop_columns(["left"])

    return merge
