"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

Base findings, leftmost and non-overlapping for each kind:

* assign: a key word, a separator and a value of eight or more characters,
* access: ``AKIA`` and capitals or digits, sixteen or more characters in all,
* hex: thirty-two or more lower-case hexadecimal digits.

Entropy findings are added to these. Candidates are the maximal runs of ``A-Za-z0-9+/_=-`` and
the maximal runs of letters and digits in them; the character class (hexadecimal, two of lower
case, upper case and digits, or mixed) sets window, threshold and needed variety. UUIDs and
alphabet-ordered pieces that stand alone in a run split it: windows lie between them, never on
them. A window slides over a candidate; the counts of its characters change by one in and one
out, and so does ``sum(c * log2(c))``, from which its entropy follows. Windows at or above the
threshold are joined. A joined span is suppressed if the allow-list's forms (UUIDs, one
repeated block, alphabet order, plain words joined by separators or capitals) cover the whole
of it; characters of base findings are taken out of it and the rest stays. The allow-list never
removes a base finding.

Defined results for odd input: a null or empty text has no findings; null ids are carried
along; equal rows each get their own result; an empty table gives an empty result. Texts are
scanned whole. Only the id and text columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import table

KINDS = ("assign", "access", "hex", "entropy")
# The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

Span = tuple[int, int, str]


@dataclass(frozen=True)
class CharClass:
    """Bits per character that a window needs, and how many kinds of character the run needs."""

    name: str
    window: int
    bits: float
    variety: int


HEX_CLASS = CharClass("hexadecimal", 24, 3.2, 2)
TWO_CLASS = CharClass("two kinds", 24, 3.8, 2)
MIXED_CLASS = CharClass("mixed", 20, 3.9, 3)
SHORTEST = min(HEX_CLASS.window, TWO_CLASS.window, MIXED_CLASS.window)
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
_HEXADECIMAL = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_IN_RUN = bytes(1 if chr(i).isascii() and (chr(i).isalnum() or chr(i) in "+/_=-") else 0 for i in range(256))
_IN_HEX = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))


def variety(run: str) -> int:
    """How many of lower case, upper case, digits and signs occur."""
    return sum(map(bool, (re.search("[a-z]", run), re.search("[A-Z]", run), re.search("[0-9]", run), re.search("[+/_=-]", run))))


def hot_windows(run: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Joined windows of ``run`` whose entropy is at least ``bits``; counts change by one character at a time."""
    weight = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]  # one comes in before one goes out
    enough = (math.log2(window) - bits) * window + 1e-9
    counts: dict[str, int] = {}
    total = 0.0
    out: list[tuple[int, int]] = []
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += weight[n + 1] - weight[n]
        if i >= window:
            gone = run[i - window]
            n = counts[gone]
            counts[gone] = n - 1
            total += weight[n - 1] - weight[n]
        if i >= window - 1 and total <= enough:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


_UUID = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![A-Za-z0-9])")
_JOINED = re.compile(r"[+/_=-]*[A-Za-z][a-z]*(?:[+/_=-]+[A-Za-z][a-z]*)*[+/_=-]*")
_CAPITALS = re.compile(r"[a-z]*(?:[A-Z]{1,5}[a-z]+)+[A-Z]*")
_PIECE = re.compile(r"[A-Za-z0-9]+")
_ORDERED = frozenset(a + b for o in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789") for a, b in zip(o, o[1:], strict=False))
#: Characters that a stretch in alphabet order needs (the last one may be cut off), and a piece of such stretches.
STRETCH, ORDERED = 4, 10
#: Longest repeated block, and characters that joined words need for each capital.
BLOCK, WORD = 12, 4


def ordered(text: str) -> bool:
    """Whether stretches in alphabet order are all there is."""
    breaks = [0, *(i for i in range(1, len(text)) if text[i - 1 : i + 1] not in _ORDERED)]
    return len(text) >= ORDERED and all(b - a >= STRETCH for a, b in zip(breaks, breaks[1:], strict=False))


def repeated(text: str) -> bool:
    """Whether a block that occurs three times or more is all there is."""
    return any(text[n:] == text[:-n] for n in range(1, min(BLOCK, len(text) // 3) + 1))


def worded(text: str) -> bool:
    """Whether words joined by capitals are all there is."""
    return _CAPITALS.fullmatch(text) is not None and len(re.findall("[A-Z]", text)) * WORD <= len(text)


def allowed(text: str) -> bool:
    """Forms that look random to a window but are known to be no secrets; each must be the whole text."""
    return bool(_UUID.fullmatch(text) or _JOINED.fullmatch(text)) or repeated(text) or ordered(text) or worded(text)


def unknown(run: str) -> list[tuple[int, int]]:
    """What is left of a run between its UUIDs and its pieces in alphabet order."""
    known = [m.span() for m in _UUID.finditer(run)]
    known += [m.span() for m in _PIECE.finditer(run) if ordered(m.group())]
    return minus((0, len(run)), known)


def minus(span: tuple[int, int], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a span that none of ``taken`` covers."""
    out, (at, end) = [], span
    for a, b in sorted(taken):
        if at < min(a, end):
            out.append((at, min(a, end)))
        at = max(at, b)
    return [*out, (at, end)] if at < end else out


def class_of(text: str) -> CharClass:
    if _HEXADECIMAL.match(text):
        return HEX_CLASS
    return TWO_CLASS if variety(text) == 2 and _PIECE.fullmatch(text) else MIXED_CLASS


def _hot(text: str, allow: Callable[[str], bool]) -> list[tuple[int, int]]:
    kind = class_of(text)
    if len(text) < kind.window or variety(text) < kind.variety:
        return []
    return [(a, b) for a, b in hot_windows(text, kind.window, kind.bits) if not allow(text[a:b])]


def entropy_spans(text: str, allow: Callable[[str], bool] = allowed) -> list[Span]:
    out: list[Span] = []
    for m in RUN.finditer(text):
        for start, end in unknown(m.group()):
            part, at = m.group()[start:end], m.start() + start
            found = [(at + a, at + b) for a, b in _hot(part, allow)]
            for p in _PIECE.finditer(part):
                if p.end() - p.start() < len(part):
                    found += [(at + p.start() + a, at + p.start() + b) for a, b in _hot(p.group(), allow)]
            joined: list[tuple[int, int]] = []
            for a, b in sorted(found):
                if joined and a <= joined[-1][1]:
                    joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
                else:
                    joined.append((a, b))
            out += [(a, b, "entropy") for a, b in joined]
    return out


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"\1" * 32 in text.encode("utf-8", "surrogatepass").translate(_IN_HEX):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def scan(text: str, allow: Callable[[str], bool] = allowed) -> list[Span]:
    """All findings of a text as (start, end, kind), by start and then kind as listed."""
    found = base_spans(text)
    if b"\1" * SHORTEST in text.encode("utf-8", "surrogatepass").translate(_IN_RUN):
        base = [(a, b) for a, b, _ in found]
        found += [(a, b, "entropy") for s in entropy_spans(text, allow) for a, b in minus((s[0], s[1]), base)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with every finding, overlapping ones as one, replaced by a mark."""
    out, at = [], 0
    for a, b, _ in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


SPANS = "array<struct<start:int,end:int,kind:string>>"


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and its findings (code points, end exclusive)."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"start": a, "end": e, "kind": k} for a, e, k in scan(x or "")] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id long, spans {SPANS}")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, findings in the text replaced by a mark; nulls stay null."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for b in batches:
            texts = [x and ((s := scan(x)) and redact(x, s) or x) for x in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, schema)


def op9_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = findings(table(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


QUERIES = {"op9_entropy_secrets": op9_entropy_secrets}
SQL: dict[str, str] = {}
