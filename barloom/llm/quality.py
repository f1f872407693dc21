"""Line-first cleaning.

Every line is judged by itself: punctuation (no sentence mark at all, or shouted marks after most words),
symbols and navigation (menu bars and symbol noise), stuttered words, and boilerplate phrases. Lines that fail are removed; a
document that loses too much of its text is rejected.

Defined results: a null or empty text has no words and is not kept; a null id is kept as it is; repeated rows give repeated results; an empty table gives an
empty result; very long texts are judged whole; columns other than doc_id and text are ignored by ``assess`` and kept as they are by
``clean_documents``, whatever their names, but for n_chars, which follows the text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import SPACE, WordHash, map_batches, shingle_hashes, table, text_bytes

SYMBOLS = b"#*$%&|<>"
#: Marks of any script that end a sentence (the Unicode property), and those that lead on or close.
MARKS = regex.findall(r"\p{STerm}", "".join(chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000)) + list(":;…\"'")
ENDS = re.compile(f"[{re.escape(''.join(MARKS))}]")
#: Scripts that set no mark at the end of a sentence.
UNMARKED, LETTER = regex.compile(r"[\p{Thai}\p{Lao}\p{Tibetan}]"), regex.compile(r"\p{L}")
PHRASES = (
    r"this work is licensed under|all rights reserved|licensed under the|permission is hereby granted|terms of (?:use|service)|privacy policy"
    r"|cookie (?:policy|settings)|accept (?:all )?cookies|sign up for our newsletter|subscribe to our|click here to|powered by|javascript (?:is|must be) (?:disabled|enabled)"
)
BOILERPLATE = re.compile(PHRASES.encode())
#: Shares of a line's words from which the line fails, and the share of the words' characters that a kept document may lose.
MOST_SYMBOLS, MOST_SHOUTS, MOST_STUTTER, MOST_LOST = 0.2, 0.3, 0.4, 0.5


def line_verdict(line: bytes, words: list[bytes] | None = None) -> str:
    """Name of the rule that a line fails; empty if it stays. Lines without a word stay."""
    words = line.split() if words is None else words
    n = len(words)
    if not n:
        return ""
    if len(line) - len(line.translate(None, SYMBOLS)) > MOST_SYMBOLS * n and n > 2:
        return "navigation" if b"|" in line else "symbols"
    if n > 2 and line.count(b"!!") > MOST_SHOUTS * n:
        return "punctuation"
    if n > 4 and sum(map(bytes.__eq__, words, words[1:])) > MOST_STUTTER * n:
        return "stutter"
    if BOILERPLATE.search(line.lower()):
        return "boilerplate"
    if n > 2 and not marked(line.decode("utf-8", "replace")):
        return "punctuation"
    return ""


def marked(line: str) -> bool:
    """Whether a line holds a sentence mark, or is written for the most part in a script without any."""
    return bool(ENDS.search(line)) or 2 * len(UNMARKED.findall(line)) > len(LETTER.findall(line))


def clean(text: str | None) -> tuple[str, float]:
    """The text without failing lines, and the share of the words' characters that went."""
    lines = (text or "").encode().split(b"\n")
    stay = [x for x in lines if not line_verdict(x)]
    size = sum(map(word_chars, lines))
    return b"\n".join(stay).decode(), (1 - sum(map(word_chars, stay)) / size if size else 0.0)


def word_chars(b: bytes) -> int:
    """Code points in words: lead bytes that are no white space."""
    return len(b.decode("utf-8", "replace")) - (len(b) - len(b.translate(None, SPACE)))


def repeat_words(h: np.ndarray) -> int:
    """Words in 8-word windows that occur twice or more."""
    if len(h) < 9:
        return 0
    w = shingle_hashes(h, 8)
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w) + 8, np.int64)
    at = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    twice[at] += 1
    np.subtract.at(twice, at + 8, 1)
    return int((np.cumsum(twice) > 0).sum())


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, lost double"


def measure(text: bytes, hashes: WordHash) -> tuple[int, int, int, int, int, bool, bool, float]:
    words = text.split()
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    dup, size, lost = 0, word_chars(text), 0
    for line in lines:
        own = line.split()
        if not own:
            continue
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        if line_verdict(line, own):
            lost += word_chars(line)
    repeats = repeat_words(hashes.of(words))
    n = len(words)
    failed = n < 20 or 100 * repeats > 30 * n
    share = lost / size if size else 0.0
    return n, size, len(text) - len(text.translate(None, SYMBOLS)), dup, repeats, failed, not failed and share <= MOST_LOST, share


def assess(docs: DataFrame) -> DataFrame:
    """A row for each document: base measures, whether it failed them, the method's verdict and the share of text lost."""
    hashes = WordHash()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(zip(*[measure(t, hashes) for t in text_bytes(b.column("text"))]))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", *NAMES, "base_failed", "kept", "lost"])

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), batch, SCHEMA)


def clean_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns, without the documents rejected and without the failing lines of the rest; n_chars follows the text."""
    hashes = WordHash()
    names = docs.columns

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = text_bytes(b.column("text"))
        kept = [i for i, t in enumerate(raw) if measure(t, hashes)[6]]
        texts = [clean(raw[i].decode())[0] for i in kept]
        rows = b.take(pa.array(kept, pa.int64()))
        new = {"text": texts, "n_chars": list(map(len, texts))}
        cols = [pa.array(new[c], rows.schema.field(c).type) if c in new else rows.column(c) for c in names]
        return pa.RecordBatch.from_arrays(cols, names)

    return map_batches(docs, batch, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"))


#: Lines, their words and what they hold, by the rules above.
SQL = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT rid, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w, length(line) - len(regexp_extract_all(line, '[\x20\x09-\x0D]')) AS size FROM u),
v AS (SELECT *, len(w) AS n FROM l),
j AS (SELECT rid, size, CASE WHEN n = 0 THEN false WHEN len(regexp_extract_all(line, '[#*$%&|<>]')) > {MOST_SYMBOLS} * n AND n > 2 THEN true WHEN n > 2 AND len(regexp_extract_all(line, '!!')) > {MOST_SHOUTS} * n THEN true
WHEN n > 4 AND len(list_filter(list_zip(w, w[2:]), lambda x: x[1] = x[2])) > {MOST_STUTTER} * n THEN true WHEN regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PHRASES}') THEN true
WHEN n > 2 AND NOT regexp_matches(line, '[{"".join(rf"\x{{{ord(c):x}}}" for c in MARKS)}]') AND NOT 2 * len(regexp_extract_all(line, '[\p{{Thai}}\p{{Lao}}\p{{Tibetan}}]')) > len(regexp_extract_all(line, '\p{{L}}')) THEN true ELSE false END AS fails FROM v),
g AS (SELECT rid, sum(size)::BIGINT AS word_chars, coalesce(sum(size) FILTER (fails), 0)::BIGINT AS gone FROM j GROUP BY rid),
e AS (SELECT rid, sum(k - 1)::BIGINT AS n_dup_lines FROM (SELECT rid, line, count(*) AS k FROM v WHERE n > 0 GROUP BY rid, line) GROUP BY rid),
t AS (SELECT rid, doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
x AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
y AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM x) WHERE c > 1) GROUP BY rid),
m AS (SELECT t.doc_id, t.n_words::BIGINT AS n_words, g.word_chars, t.n_symbols::BIGINT AS n_symbols, coalesce(e.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(y.n_repeat_words, 0)::BIGINT AS n_repeat_words,
CASE WHEN g.word_chars > 0 THEN g.gone::DOUBLE / g.word_chars ELSE 0.0 END AS lost FROM t JOIN g USING (rid) LEFT JOIN e USING (rid) LEFT JOIN y USING (rid))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost <= {MOST_LOST} AS kept FROM m"""
