"""Byte-level BPE encoding and decoding with Spark higher-order functions.

Each partition is one pipelined pass without a shuffle:

1. texts are split by the tokenizer's pattern; every word that is new to the partition becomes a
   row of its own, and a text becomes the numbers of its words;
2. on word rows, a fold over the word's array of bytes applies the lowest-ranked merge until none is left (``aggregate``), with the ranks of symbol pairs in constant arrays; a second fold
   concatenates the binary pieces of the ids, which is decoding;
3. texts are put together from the results of their words.

The ranks sit in two constant arrays: every left symbol has an offset, and the pair's id is at the
offset plus the right symbol, so a lookup is two array accesses inside the JVM, whatever the size of
the vocabulary. What a partition remembers are its distinct
words; past ``REMEMBER`` words it starts anew, so memory is bounded.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import batches

REMEMBER = 500_000
#: Above all ids and ranks.
_NONE = 1 << 16
#: A number of the fold's state is rank * 2**46 + place * 2**16 + symbol.
_PAIR_BITS = 46
_PAIR = 1 << _PAIR_BITS


@dataclass(frozen=True)
class Ranks:
    """Ranks of a ``tiktoken`` file: the rank of a byte string is its token id."""

    pieces: list[bytes]
    single: np.ndarray  #: id of each byte
    first: np.ndarray  #: at byte * 256 + next byte: their pair's id or ``_NONE``, times ``_PAIR``, plus the byte's id
    base: np.ndarray  #: offset of each left symbol
    table: np.ndarray  #: at offset + right symbol: left symbol << 16 | id of the pair; free places are far above

    @classmethod
    def load(cls, path: str) -> Ranks:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        if max(ranks.values()) >= _NONE:
            raise ValueError("ids need more than 16 bits")
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, r in ranks.items():
            pieces[r] = piece
        rows: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
        for piece, r in ranks.items():
            for i in range(1, len(piece)):
                a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
                if a is not None and b is not None:
                    rows[a].append((b, r))
        single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        first = [min(ranks.get(bytes([i, j]), _NONE), _NONE) * _PAIR + single[i] for i in range(256) for j in range(256)]
        return cls(pieces, single, np.array(first, np.int64), *_displace(rows, len(pieces)))


def _displace(rows: dict[int, list[tuple[int, int]]], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of left symbols, and the table in which their rows (right symbol, id) don't overlap.

    The longest rows come first; each takes the first of a fixed sequence of offsets that fits. A table
    eight times as long as all rows together has room for short rows nearly anywhere.
    """
    room = 8 * max(1, sum(map(len, rows.values())))
    base, table = np.zeros(symbols, np.int64), np.full(room + symbols, 1 << 62, np.int64)
    free = np.ones(room + symbols, bool)
    rng = np.random.default_rng(0)
    for left in sorted(rows, key=lambda a: (-len(rows[a]), a)):
        right, made = np.array(rows[left], np.int64).T
        while True:
            tried = rng.integers(0, room, 64)
            fits = free[tried[:, None] + right].all(axis=1)
            if fits.any():
                break
        base[left] = tried[fits.argmax()]
        table[base[left] + right] = left * _NONE + made
        free[base[left] + right] = False
    return base, table


def _bound(values: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with its argument bound to ``values`` once per row."""
    return F.transform(F.array(values), body)[0]


class Codec:
    """The ranks as constants of a plan: one-row tables read as scalars, so each task gets them
    once, as plain memory blocks."""

    def __init__(self, spark: SparkSession, ranks: Ranks) -> None:
        one = pa.table({"table": [ranks.table], "base": [ranks.base], "first": [ranks.first], "last": [ranks.single + _NONE * _PAIR]})
        self.names = one.column_names
        self.row = spark.createDataFrame(one)
        self.pieces = ranks.pieces

    def bind(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the constants as columns. The optimizer moves each into the one
        expression that reads it, so they are never copied into rows."""
        return rows.withColumns({f"_{c}": self.row.select(c).scalar() for c in self.names})

    def encode(self, word: Column) -> Column:
        """Ids (array of long) of ``word``, an array of a word's bytes as numbers from 0. It takes time that
        grows with the square of a word's length.

        The fold's state has one number for each symbol: the rank of its pair with the next symbol
        (65536 for none), the symbol's first place in the word, and the symbol. So numbers differ,
        and the least one is the leftmost pair of the lowest rank.
        """

        def symbol(x: Column) -> Column:
            return x.bitwiseAND(F.lit(_NONE - 1))

        def fold(table: Column, base: Column, first: Column, last: Column) -> Column:
            def paired(a: Column, b: Column) -> Column:
                # exclusive-or with the left symbol leaves the pair's id, or a number of 65536 or more;
                # the next symbol is null at the end, and ``least`` skips nulls
                return F.least(F.get(table, F.get(base, a) + b).bitwiseXOR(a * _NONE), F.lit(_NONE)) * _PAIR

            def start(x: Column, i: Column) -> Column:
                return F.coalesce(F.get(first, x * 256 + F.get(word, i + 1)), F.get(last, x)) + i.cast("long") * _NONE

            def merge(a: Column, p: Column) -> Column:
                # the pair of the least number is at p and p + 1, from 1; its neighbours get new ranks,
                # what follows moves up by one, and a null is left at the end
                new = F.shiftright(F.get(a, p - 1), _PAIR_BITS)

                def place(x: Column, i: Column) -> Column:
                    return (F.when(i >= p, F.get(a, i + 1)).when(i + 2 < p, x)
                            .when(i + 1 < p, paired(symbol(x), new) + x.bitwiseAND(F.lit(_PAIR - 1)))
                            .otherwise(paired(new, symbol(F.get(a, p + 1))) + x.bitwiseAND(F.lit(_PAIR - _NONE)) + new))

                return F.transform(a, place)

            def step(a: Column, _: Column) -> Column:
                # the least number is looked for twice, which takes less than binding it
                return F.when(F.array_min(a) < _NONE * _PAIR, _bound(
                    F.array_position(a, F.array_min(a)).cast("int"), lambda p: merge(a, p))).otherwise(a)

            # as many rounds as bytes are always enough
            return F.aggregate(word, F.transform(word, start), step,
                               lambda a: F.transform(F.filter(a, lambda x: x.isNotNull()), symbol))

        folded = _bound(F.col("_table"), lambda t: _bound(F.col("_base"), lambda h: _bound(
            F.col("_first"), lambda g: _bound(F.col("_last"), lambda z: fold(t, h, g, z)))))
        return F.when(F.size(word) > 0, folded).otherwise(F.array().cast("array<bigint>"))

    def decode(self, ids: Column) -> Column:
        """Bytes of an array of ids: their binary pieces, concatenated (as hexadecimal digits, which
        a literal array holds); an unknown id is an error."""
        pieces = F.split(F.lit(",".join(p.hex() for p in self.pieces)), ",")
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(pieces, (i + 1).cast("int"))), ""))


#: Letters, numerals and white space of Latin-1, for the tokenizer's pattern on bytes.
_L, _N, _S = rb"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe", rb"\x09-\x0d\x20\x85\xa0"
_LATIN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[%b]+| ?[%b]+| ?[^%b%b%b]+|[%b]+(?![^%b])|[%b]+"
                    % (_L, _N, _S, _L, _N, _S, _S, _S))


def split_words(text: str, pattern: regex.Pattern) -> tuple[list[bytes], bool]:
    """The pattern's matches, and whether they are Latin-1 (else UTF-8) bytes."""
    try:
        return _LATIN.findall(text.encode("latin-1")), True
    except UnicodeEncodeError:
        return [x.encode("utf-8", "surrogatepass") for x in pattern.findall(text)], False


_ROWS = pa.schema([("id", pa.int64()), ("word", pa.list_(pa.int16())), ("numbers", pa.binary())])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary: little-endian unsigned 32-bit, decoded binary) for every row.

    Null text counts as empty and has no ids. Special tokens are ordinary text. Long texts and
    words are encoded whole; repeated rows repeat their result; an empty table gives none.
    """
    ranks = Ranks.load(ranks_path)
    latin = pattern == _KNOWN_PATTERN

    def split(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        index: defaultdict[bytes, int] = defaultdict(count().__next__)
        told = 0
        for batch in batches(frames, 500):
            if len(index) > REMEMBER:
                # a row without word and numbers tells the last step to start anew
                index, told = defaultdict(count().__next__), 0
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, _ROWS.types[1]), pa.nulls(1, pa.binary())],
                                                 schema=_ROWS)
            numbers = []
            for x in batch.column(1):
                text = x.as_py() or ""
                words, is_latin = split_words(text, compiled) if latin else (
                    [w.encode("utf-8", "surrogatepass") for w in compiled.findall(text)], False)
                if is_latin and not text.isascii():
                    words = [w if w.isascii() else w.decode("latin-1").encode() for w in words]
                numbers.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)).tobytes())
            new = list(islice(reversed(index), len(index) - told))[::-1]
            told = len(index)
            for i in range(0, len(new), 20_000):
                part = new[i:i + 20_000]
                ends = np.r_[0, np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))]
                values = np.frombuffer(b"".join(part), np.uint8).astype(np.int16)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(part), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
                     pa.nulls(len(part), pa.binary())], schema=_ROWS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.nulls(len(numbers), _ROWS.types[1]), pa.array(numbers, pa.binary())], schema=_ROWS)

    def put_together(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, text = _Runs(np.dtype("<u4")), _Runs(np.dtype(np.uint8))
        for batch in batches(frames, 20_000):
            is_word = batch.column(1).to_numpy(zero_copy_only=False)
            is_doc = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            at = 0
            cuts = np.flatnonzero((is_word[1:] != is_word[:-1]) | (is_doc[1:] != is_doc[:-1])) + 1
            for stop in [*cuts.tolist(), batch.num_rows]:
                part = batch.slice(at, stop - at)
                if is_word[at]:
                    lists = part.column(3)
                    ids.add(lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
                    found = part.column(4)
                    sizes = pa.compute.binary_length(found).to_numpy(zero_copy_only=False)
                    text.add(np.frombuffer(b"".join(found.to_pylist()), np.uint8), sizes)
                elif is_doc[at]:
                    for i in range(0, part.num_rows, 100):
                        own = part.slice(i, 100)
                        numbers = own.column(2)
                        yield pa.RecordBatch.from_arrays(
                            [own.column(0), ids.gather(numbers), text.gather(numbers)], names=["id", "ids", "decoded"])
                else:
                    ids, text = _Runs(np.dtype("<u4")), _Runs(np.dtype(np.uint8))
                at = stop

    rows = (docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
            .mapInArrow(split, "id long, word array<smallint>, numbers binary"))
    codec = Codec(docs.sparkSession, ranks)
    words = codec.bind(rows).select("id", F.col("word").isNotNull().alias("is_word"), "numbers", F.when(
        F.col("word").isNotNull(), codec.encode(F.col("word"))).alias("ids"))
    whole = words.select("id", "is_word", "numbers", "ids", codec.decode(F.col("ids")).alias("decoded"))
    return whole.mapInArrow(put_together, "id long, ids binary, decoded binary")


#: The pattern that ``_LATIN`` restates for Latin-1 bytes (fixed value of public tokenizers).
_KNOWN_PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


class _Runs:
    """Runs of numbers, one per word, gathered for whole texts."""

    def __init__(self, kind: np.dtype) -> None:
        self.flat, self.stop, self.words = np.zeros(1 << 16, kind), np.zeros(1 << 12, np.int64), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        used, n = int(self.stop[self.words]), len(sizes)
        while used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.words + n + 1 > len(self.stop):
            self.stop = np.concatenate([self.stop, np.zeros_like(self.stop)])
        self.flat[used:used + len(flat)] = flat
        self.stop[self.words + 1:self.words + n + 1] = used + np.cumsum(sizes)
        self.words += n

    def gather(self, numbers: pa.BinaryArray) -> pa.BinaryArray:
        """For each row (32-bit numbers of words, one after another) its words' runs, as bytes."""
        ends = np.frombuffer(numbers.buffers()[1], np.int32)[numbers.offset:numbers.offset + len(numbers) + 1].astype(np.int64)
        flat = np.frombuffer(numbers.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]].view(np.int32)
        start = self.stop[flat]
        sizes = self.stop[flat + 1] - start
        reached = np.r_[0, np.cumsum(sizes)]
        data = self.flat[np.repeat(start - reached[:-1], sizes) + np.arange(reached[-1])]
        offsets = reached[(ends - ends[0]) // 4] * data.itemsize
        if offsets[-1] >= 1 << 31:  # too much for one array: row by row
            return pa.array([data[a:b].tobytes() for a, b in zip(offsets[:-1] // data.itemsize, offsets[1:] // data.itemsize, strict=True)], pa.binary())
        return pa.BinaryArray.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def encode_words(spark: SparkSession, words: list[bytes], ranks_path: str) -> list[list[int]]:
    """Ids of a few words, for tests."""
    rows = spark.createDataFrame([(i, list(w)) for i, w in enumerate(words)], "i int, word array<smallint>")
    codec = Codec(spark, Ranks.load(ranks_path))
    return [x["ids"] for x in codec.bind(rows).select("i", codec.encode(F.col("word")).alias("ids")).orderBy("i").collect()]

