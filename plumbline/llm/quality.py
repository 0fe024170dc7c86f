"""Line-first quality cleaning.

Every line is judged (punctuation, navigation and boilerplate rules); failing lines go; a document
that lost too much of its text goes as a whole. Word statistics of the whole text are reported
beside the verdict.

* Punctuation: lines mostly of words with symbols or shouted words, and short lines that break off
  in an ellipsis, as teasers do.
* Navigation: menus, by separators between entries or as runs of short lines without such marks.
* Boilerplate: short lines of licences, rights, cookie and site notices in English, German, French
  and Spanish, or with nothing but an address.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches

SYMBOLS = "#*$%&|<>"
#: Phrases of licence and site boilerplate; a short line with one of them fails.
BOILERPLATE = (
    # English
    "all rights reserved", "licensed under", "released under", "general public license", "terms of use",
    "terms of service", "privacy policy", "cookie policy", "accept cookies", "enable javascript",
    "click here", "sign up", "log in", "subscribe to our newsletter", "powered by",
    # German
    "alle rechte vorbehalten", "lizenziert unter", "nutzungsbedingungen", "datenschutzerklärung", "impressum",
    "cookies akzeptieren", "hier klicken", "jetzt anmelden", "newsletter abonnieren",
    # French
    "tous droits réservés", "sous licence", "conditions d'utilisation", "politique de confidentialité",
    "mentions légales", "accepter les cookies", "cliquez ici", "se connecter", "abonnez-vous",
    # Spanish
    "todos los derechos reservados", "bajo la licencia", "términos de uso", "política de privacidad", "aviso legal",
    "aceptar cookies", "haga clic aquí", "iniciar sesión", "suscríbase",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules; every fraction is of the line's words or characters."""

    min_words: int = 50  #: documents below fail
    max_repeat: float = 0.5  #: most words in repeated 3-word windows
    max_symbol_words: float = 0.3  #: words that carry a symbol
    max_shouted: float = 0.3  #: words that end in two or more exclamation or question marks
    max_bars: float = 0.2  #: words that are a menu separator
    max_teaser_words: int = 20  #: a longer line may end in an ellipsis
    max_entry_words: int = 4  #: a line without marks of up to so many words may be a menu's entry
    max_entries: int = 3  #: entries that may follow each other
    max_boilerplate_words: int = 20  #: a longer line is no mere boilerplate line
    max_lost: float = 0.5  #: word characters that may go with failing lines


SEPARATORS = ("|", "»", "›", "•", "·")
_SEPARATORS = {x.encode() for x in SEPARATORS}
_SYMBOL = re.compile(rb"[#*$%&<>]")
_SHOUT = re.compile(rb"[!?]{2,}(?=[ \t\r\x0b\x0c]|$)")
_ELLIPSES = (b"...", "…".encode(), "[…]".encode())
#: A symbol or the year of a copyright, and a bare address, are boilerplate too.
NOTICE = "|".join([*BOILERPLATE, r"(?:©|\(c\)|copyright)[ \t]*(?:©|\(c\))?[ \t]*(?:19|20)[0-9][0-9]",
                   r"^[ \t]*(?:https?://|www\.)[^ \t]+[ \t\r]*$"])
_BOILERPLATE = re.compile(NOTICE)
#: Marks that end or divide sentences: Latin, Greek, Arabic, Devanagari, Chinese and Japanese.
MARKS = ".!?:;,…\u037e\u061b\u061f\u06d4\u0964\u3001\u3002\uff01\uff0c\uff1a\uff1f"
_MARK = re.compile("|".join(map(re.escape, MARKS)).encode())


def entries(words: list[list[bytes]], lines: list[bytes], rules: LineRules) -> list[bool]:
    """Which lines are entries of a menu: more than ``max_entries`` short lines without a mark, one
    after another; lines without words between them don't count."""
    out = [False] * len(lines)
    run: list[int] = []
    for i, own in enumerate([*words, [b"."] * (rules.max_entry_words + 1)]):
        if not own:
            continue
        if len(own) <= rules.max_entry_words and not _MARK.search(lines[i]):
            run.append(i)
            continue
        if len(run) > rules.max_entries:
            for k in run:
                out[k] = True
        run = []
    return out


def line_fails(line: bytes, words: list[bytes], rules: LineRules) -> str:
    """The rule that the line breaks, or an empty string."""
    n = len(words)
    if sum(map(words.count, _SEPARATORS)) > rules.max_bars * n:
        return "navigation"
    if _SYMBOL.search(line) and sum(1 for w in words if _SYMBOL.search(w)) > rules.max_symbol_words * n:
        return "punctuation"
    if (b"!!" in line or b"??" in line or b"?!" in line or b"!?" in line) and (
            len(_SHOUT.findall(line)) > rules.max_shouted * n):
        return "punctuation"
    if n <= rules.max_teaser_words and words[-1].endswith(_ELLIPSES):
        return "punctuation"
    if n <= rules.max_boilerplate_words and _BOILERPLATE.search(line.decode("utf-8", "surrogatepass").lower()):
        return "boilerplate"
    return ""


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in 3-word windows found twice or more, first occurrences included."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    m = len(seen)
    if m < 2_000_000:  # three ids fit one integer
        window = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
    else:
        pair = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)[1]
        window = pair[:-1] * m + ids[2:]
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(window), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def judge(text: str | None, rules: LineRules = LineRules()) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    lines_removed, chars_removed, cleaned text) of one text; null counts as no words."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "surrogatepass"))
    symbols = sum(map(joined.count, (c.encode() for c in SYMBOLS)))
    repeats = repeated_words(words)
    lines = data.split(b"\n")
    earlier: set[bytes] = set()
    duplicates = removed = lost = 0
    kept_lines = []
    total = 0
    split = [line.split() for line in lines]
    menu = entries(split, lines, rules)
    for line, own, entry in zip(lines, split, menu, strict=True):
        if not own:
            kept_lines.append(line)
            continue
        duplicates += line in earlier
        earlier.add(line)
        size = sum(map(len, own))
        total += size
        if entry or line_fails(line, own, rules):
            removed += 1
            lost += size
        else:
            kept_lines.append(line)
    failed = len(words) < rules.min_words or repeats > rules.max_repeat * len(words)
    kept = not failed and lost <= rules.max_lost * total
    return (len(words), chars, symbols, duplicates, repeats, failed, kept, removed, lost,
            b"\n".join(kept_lines).decode("utf-8", "surrogatepass") if removed else text)


REPORT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, lines_removed long, bytes_removed long, cleaned_text string")
_KINDS = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(),
            with_text: bool = False) -> DataFrame:
    """Statistics and verdict for every row: (id, the columns of ``REPORT``).

    Without ``with_text`` the cleaned text is left out. A null text has no words and fails.
    Texts are judged whole, one at a time; repeated rows give repeated verdicts; an empty
    table gives an empty result; other columns are ignored.
    """
    names = [c.split()[0] for c in REPORT.split(", ")]
    used = names if with_text else names[:-1]
    kinds = _KINDS if with_text else _KINDS[:-1]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, 500):
            rows = [judge(x.as_py(), rules)[: len(used)] for x in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [()] * len(used)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["id", *used])

    schema = ", ".join(["id long", *REPORT.split(", ")[: len(used)]])
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                       F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules(),
              count_col: str | None = None) -> DataFrame:
    """The rows whose document is kept, their text without the failing lines.

    All columns stay, whatever their names; ``count_col``, if given, gets the new number of code
    points. A null or empty text has no words, so its row goes. Texts are judged whole, whatever
    their length; repeated rows are judged alike; a text without failing lines is unchanged; an empty
    table stays empty. No shuffle.
    """
    at = docs.columns.index(text_col)
    counted = docs.columns.index(count_col) if count_col else None

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, 500):
            verdicts = [judge(x.as_py(), rules) for x in batch.column(at)]
            keep = pa.array([v[6] for v in verdicts], pa.bool_())
            texts = pa.array([v[-1] for v in verdicts], batch.schema.field(at).type)
            out = batch.set_column(at, batch.schema.field(at), texts)
            if counted is not None:
                sizes = pa.array([len(v[-1]) for v in verdicts], batch.schema.field(counted).type)
                out = out.set_column(counted, batch.schema.field(counted), sizes)
            yield out.filter(keep)

    return docs.mapInArrow(run, docs.schema)
