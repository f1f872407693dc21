"""Secret scans.

Fixed patterns find assignments, access keys and hex strings. Beside them, windows slide over candidate
strings; each keeps counts per character class and updates Shannon entropy from the one character that
leaves and the one that enters. Windows over the threshold of their class merge into spans, unless an
allow-list knows the string.

Defined results: a null text counts as empty and has no spans; positions are code points, ends exclusive; spans that begin at one place stand in
order of their kinds; a null id is kept; repeated rows give repeated results; an empty table gives an empty result; very long texts and tokens are read whole, one window at
a time; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Per character class: pattern of its characters, window, bits of entropy from which a window counts.
CLASSES = (("hex", re.compile(r"[0-9A-Fa-f]+"), 32, 3.0), ("base64", re.compile(r"[A-Za-z0-9+/=_-]+"), 20, 3.9))
#: Strings that look random and are public by their nature.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"sha(?:1|256|384|512)-[A-Za-z0-9+/]+=*"),
    re.compile(r"(?i).*(?:example|placeholder|changeme|dummy|xxxxx|abcdefghij|0123456789).*"),
)


def windows(s: str, w: int) -> Iterator[tuple[float, bool]]:
    """Shannon entropy in bits of every window of ``w`` characters, and whether it looks random, by incremental counts.

    With c the counts of a window, its entropy is log2(w) - sum(c log2 c) / w; a step changes two terms. A secret mixes at
    least three digits with letters; words and paths don't. Only the counts of one window are held, however long the string is.
    """
    term = [0.0] + [c * math.log2(c) for c in range(1, w + 2)]
    counts: dict[str, int] = {}
    total, digits, letters, top = 0.0, 0, 0, math.log2(w)
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        total += term[c + 1] - term[c]
        counts[ch] = c + 1
        digits += ch.isdigit()
        letters += ch.isalpha()
        if i >= w:
            old = s[i - w]
            c = counts[old]
            total += term[c - 1] - term[c]
            counts[old] = c - 1
            digits -= old.isdigit()
            letters -= old.isalpha()
        if i >= w - 1:
            yield top - total / w, digits >= 3 and letters > 0


def window_entropies(s: str, w: int) -> Iterator[float]:
    return (e for e, _ in windows(s, w))


def random_runs(s: str, w: int, least: float) -> Iterator[tuple[int, int]]:
    """Runs of windows of at least so much entropy that look random; windows that touch are one run."""
    a, b = 0, -1
    for i, (e, mixed) in enumerate(windows(s, w)):
        if e >= least and mixed:
            if i > b:
                if b >= 0:
                    yield a, b
                a = i
            b = i + w
    if b >= 0:
        yield a, b


def looks_random(s: str) -> bool:
    return sum(map(str.isdigit, s)) >= 3 and any(map(str.isalpha, s))


def entropy_spans(text: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if not looks_random(s) or any(a.fullmatch(s) for a in ALLOWED):
            continue
        hit: list[tuple[int, int]] = []
        for _, chars, w, least in CLASSES:
            for part in chars.finditer(s):
                if part.end() - part.start() >= w:
                    at = m.start() + part.start()
                    hit += [(at + a, at + b) for a, b in random_runs(part.group(), w, least)]
        for a, b in sorted(hit):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
    return out


KEYWORD = re.compile(r"(?ai:pass|secret|token|api)")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    if KEYWORD.search(text):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def joined(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]))))


def sha(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_entropy bigint"


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document with its spans of every kind."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(6)]
        for t in b.column("text").to_pylist():
            base = base_spans(t or "")
            more = [("entropy", *x) for x in entropy_spans(t or "")]
            row = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]] + [sha(joined(base, KINDS)), joined(base + more, KINDS), len(more)]
            for c, x in zip(cols, row):
                c.append(x)
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), batch, SCHEMA)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[{}]") -> str:
    """``text`` with every span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if b <= at:
            continue
        out += [text[at : max(a, at)], mark.format(k.upper()) if a >= at else ""]
        at = b
    return "".join(out) + text[at:]


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
