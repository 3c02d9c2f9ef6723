"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import mapped_text, texts

# --- Fixed values: the base patterns and the shortest value or match that counts --------------
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")
# ----------------------------------------------------------------------------------------------
WINDOW = 20
# Character classes of the entropy windows and the bits per character a secret has at least:
# a random window of 20 has about 3.5 bits in the first and 4.1 in the second class.
CLASSES = {"hex": (r"[0-9a-fA-F]+", 3.1), "base64": (r"[A-Za-z0-9+/_-]+={0,2}", 3.8)}
# Candidates that are no secrets: words, numbers, UUIDs, paths and dashed words.
ALLOWED = (
    r"[A-Za-z]+",
    r"[0-9_-]+",
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[/_=+-]*([A-Za-z]+[0-9]{0,4}[/_=+-]+)*[A-Za-z]*[0-9]{0,4}",
)

# Words have few capitals after a small letter: one in so many letters. Random letters have one in
# four, so that mixed case is judged by its entropy.
LETTERS_A_CAPITAL = 7
INNER_CAPITAL = re.compile("[a-z][A-Z]")

Span = tuple[int, int, int]


def cased_as_words(text: str) -> bool:
    """Whether the letters are cased as words are: small, capital, capitalised, or joined by a few capitals."""
    capitals = len(INNER_CAPITAL.findall(text))
    return not capitals or LETTERS_A_CAPITAL * capitals <= sum(map(str.isalpha, text))


def entropy_windows(text: str, width: int, least: float) -> list[tuple[int, int]]:
    """Unions of the windows of ``width`` whose Shannon entropy is at least ``least`` bits.

    Moving on by one character changes two counts, so each window costs two updates of the sum
    of c log2 c; the entropy is log2(width) - sum / width.
    """
    if len(text) < width:
        return []
    part = [0.0, 0.0] + [c * math.log2(c) for c in range(2, width + 2)]
    counts: dict[str, int] = {}
    total, most = 0.0, width * (math.log2(width) - least) + 1e-9
    found: list[tuple[int, int]] = []
    for end, char in enumerate(text, 1):
        c = counts.get(char, 0)
        total += part[c + 1] - part[c]
        counts[char] = c + 1
        start = end - width
        if start > 0:
            old = text[start - 1]
            c = counts[old]
            total += part[c - 1] - part[c]
            counts[old] = c - 1
        if start >= 0 and total <= most:
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], end)
            else:
                found.append((start, end))
    return found


class Scanner:
    """Finds the spans of one text: (start, kind's place in ``KINDS``, end), in that order."""

    def __init__(self, window: int = WINDOW, classes=None, allowed: Sequence[str] = ALLOWED) -> None:
        self.window = window
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access = re.compile(r"AKIA[A-Z0-9]+")
        # Runs too short to count never need to be matched: a run of the class is taken whole.
        self.hex = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{HEX_LEAST},}}")
        self.candidate = re.compile(rf"[A-Za-z0-9+/_-]{{{window},}}={{0,2}}")
        self.classes = [(re.compile(p), least) for p, least in (classes or CLASSES).values()]
        self.allowed = re.compile("|".join(f"(?:{p})" for p in allowed)) if allowed else None

    def base(self, text: str) -> list[Span]:
        found: list[Span] = []
        low = text.lower()
        if any(word in low for word in ASSIGN_WORDS):
            found += [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if len(m[0]) >= ACCESS_LEAST]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(found)

    def entropy(self, text: str) -> list[Span]:
        found: set[tuple[int, int]] = set()
        for m in self.candidate.finditer(text):
            if self.allowed and self.allowed.fullmatch(m[0]) and cased_as_words(m[0]):
                continue
            for pattern, least in self.classes:
                for run in pattern.finditer(m[0]):
                    shift = m.start() + run.start()
                    found |= {(shift + a, shift + b) for a, b in entropy_windows(run[0], self.window, least)}
        merged: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return [(a, 3, b) for a, b in merged]

    def spans(self, text: str) -> list[Span]:
        return sorted(self.base(text) + self.entropy(text))


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secret_spans(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """``doc_id`` and ``spans``: array of (kind, start, end), code points, end exclusive.

    One row per row of ``docs``, whatever its id. The base kinds are ``assign``, ``access`` and
    ``hex``; ``entropy`` spans are added, never replacing base ones. A null or empty text has no
    spans. Whole texts are read, one pass, no shuffle; other columns are ignored.
    """
    scan = scanner or Scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan.spans(text)]
                for text in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, SPAN_TYPE)], ["doc_id", "spans"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return texts(docs, "doc_id").mapInArrow(run, schema)


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans and all spans as text, from ``secret_spans``."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:3]]
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame, scanner: Scanner | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every found span replaced by ``mark``; overlapping spans become one mark.

    Rows and columns stay as they are otherwise; a null text stays null.
    """
    scan = scanner or Scanner()

    def masked(text: str) -> str:
        out, at = [], 0
        for a, _, b in scan.spans(text):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]]) if out else text

    return mapped_text(docs, masked)
