"""Secret scan with corpus-wide ownership frequency.

Pattern spans are found per text. Every candidate value is then hashed and counted over the
whole corpus by distinct repositories and distinct owners: a value seen under many owners is a
copied example (documentation, templates); a value confined to few owners looks live. Generic
high-entropy tokens, too weak to report alone, become spans when their ownership says so.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches, materialise, numbered

#: Base kinds in their listed order; a span's kind sorts by this order at equal starts.
KINDS = ("assign", "access", "hex", "owned")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
#: One of these, in any case, is in every text that has an assignment.
_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Further shapes whose hits count only if their ownership is narrow.
_SHAPES = re.compile(
    r"gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+|AIza[A-Za-z0-9_-]{35}"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{24,}={0,2}", re.A)
MIN_ENTROPY = 3.0


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) of the base kinds, leftmost and not overlapping within a kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), 0, m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2, m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def further_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidates outside the base spans that need ownership to count."""
    out = []
    for m in _SHAPES.finditer(text):
        if not any(s < m.end() and m.start() < e for s, e, _, _ in base) and entropy(m[0]) >= MIN_ENTROPY:
            out.append((m.start(), m.end(), 3, m[0]))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k, *_ in sorted(spans, key=lambda x: (x[0], x[2])))


_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("hash", pa.int64())]))


def _scan(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(frames, 500):
        ids, owners = batch.column(0), batch.column(1)
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base", "found")}
        for x in batch.column(2):
            text = x.as_py() or ""
            base = base_spans(text)
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(s[2] == k for s in base))
            out["base"].append(_joined(base))
            out["found"].append([
                {"start": s, "end": e, "kind": k,
                 "hash": int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little", signed=True)}
                for s, e, k, v in [*base, *further_spans(text, base)]])
        yield pa.RecordBatch.from_arrays(
            [ids, owners, *(pa.array(out[k], pa.int64()) for k in ("n_assign", "n_access", "n_hex")),
             pa.array(out["base"], pa.string()), pa.array(out["found"], _FOUND)],
            names=["id", "owner", *out])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         example_owners: int = 3) -> DataFrame:
    """Spans with ownership for every row.

    Returns (id, n_assign, n_access, n_hex, base, spans array of (start, end, kind, n_repositories,
    n_owners, example)). The repository of a text is its row's id, its owner ``owner_col`` (null
    counts as one owner of its own). A value under ``example_owners`` owners or more is an
    example. Spans of kind 3 ("owned") are only those that are no examples; base spans always
    stay. Counting goes through (value, owner) partial sums, so a value in a third of all rows
    shrinks before the shuffle; the ownership table is written, so the hits of a hot value can be split
    over tasks in the join. Null and empty texts have no spans; repeated rows repeat their
    result; an empty table gives an empty result.
    """
    rows = materialise(
        docs.select(F.col(f"`{id_col}`").alias("id"),
                    F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("\0")).alias("owner"),
                    F.col(f"`{text_col}`").alias("text"))
        .mapInArrow(_scan, f"id {docs.schema[id_col].dataType.simpleString()}, owner string, n_assign long, n_access long, n_hex long, base string, "
                           "found array<struct<start:int,end:int,kind:int,hash:long>>")
        .withColumn("row", F.monotonically_increasing_id()), "secrets")
    hits = rows.where(F.size("found") > 0).select("row", "id", "owner", F.explode("found").alias("f")).select(
        "row", "id", "owner", "f.*")
    # a repository has one owner, so its repositories add up over the owners; the same id under
    # several owners counts under each
    owned = materialise(
        hits.groupBy("hash", "owner", "id").agg(F.lit(1).alias("one"))
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners")), "owned")
    judged = (hits.join(owned, "hash")
              .withColumn("example", F.col("n_owners") >= example_owners)
              .where("kind < 3 or not example")
              .groupBy("row").agg(F.sort_array(F.collect_list(
                  F.struct("start", "kind", "end", "n_repositories", "n_owners", "example"))).alias("spans")))
    return rows.join(judged, "row", "left").select(
        "id", "n_assign", "n_access", "n_hex", "base",
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,kind:int,end:int,n_repositories:long,"
                                   "n_owners:long,example:boolean>>)")).alias("spans"))


def labelled(spans: str = "spans") -> F.Column:
    """The spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cut(text: str, spans: list[dict], mark: str) -> str:
    """``text`` with the union of the spans replaced by ``mark``."""
    out, at, start = [], 0, None
    end = 0
    for s in spans:
        if start is None or s["start"] > end:
            if start is not None:
                out += [text[at:start], mark]
                at = end
            start, end = s["start"], s["end"]
        else:
            end = max(end, s["end"])
    if start is not None:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
           count_col: str | None = None, example_owners: int = 3, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live-looking span replaced by ``mark``; copied examples stay.

    All rows and columns stay, whatever their names; ``count_col`` gets the new number of code points.
    Only texts with a live span are changed; null and empty texts have none. Repeated ids are safe:
    verdicts are joined by id and text digest, and repeated rows are changed alike. An empty table
    stays empty; texts are searched whole, whatever their length.
    """
    live = F.filter("spans", lambda s: ~s["example"])
    names = docs.columns
    at = names.index(text_col)
    counted = names.index(count_col) if count_col else None
    keyed = numbered(docs).withColumn("key", F.sha2(F.concat_ws(
        "\0", F.coalesce(F.col(f"c{names.index(id_col)}").cast("string"), F.lit("-")), F.sha2(F.col(f"c{at}"), 256)), 256))
    found = (scan(keyed, "key", f"c{at}", f"c{names.index(owner_col)}", example_owners)
             .select(F.col("id").alias("key"), live.alias("live")).where(F.size("live") > 0)
             .dropDuplicates(["key"]))
    joined = keyed.join(found, "key", "left").drop("key")
    schema = numbered(docs).schema

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, 500):
            spans = batch.column(batch.num_columns - 1).to_pylist()
            texts = batch.column(at).to_pylist()
            new = [t if not s or t is None else _cut(t, s, mark) for t, s in zip(texts, spans, strict=True)]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if counted is not None:
                old = columns[counted].to_pylist()
                columns[counted] = pa.array(
                    [len(n) if s and n is not None else o for n, s, o in zip(new, spans, old, strict=True)],
                    batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(run, schema).toDF(*names)
