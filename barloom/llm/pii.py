"""Information-theoretic sanitisation of personal data.

Protected entities are found by fixed patterns (email, ip, card, phone). The corpus then tells how much a
term in an entity's documents reveals it: with document frequencies of the entity c, the term t and both, the term
discloses c if PMI(c; t) >= alpha * IC(c), and if at least ``support`` different texts say so, so that
copies of one document are no evidence. Disclosing terms become spans of kind ``term`` wherever they stand, in
documents without the entity too, and are removed from the text; entities are generalised to the name of their kind.

A word is a run of other characters than the six ASCII blanks, everywhere; its term is that run in lower case without marks at its ends, of three
characters or more. Terms are told apart by 64-bit hashes.

Defined results: a null text counts as empty and has no spans; positions are code points, ends exclusive; repeated rows
give repeated results, and each counts as a document of its own, but as no text of its own; spans that begin at one place stand in order of their kinds, and
a term that touches an entity is none; a null id is kept; very long texts are read whole; an empty table gives an empty result; columns other than doc_id and text are
ignored by ``detect`` and kept as they are by ``sanitise``, whatever their names, but for n_chars, which follows the text.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, map_batches, small_batches, table, text_bytes, written
from .secrets import joined, redact, sha

KINDS = ("email", "ip", "card", "phone", "term")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
#: The local part of an address is found backwards from its @, so long runs without one cost nothing.
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ALPHA, SUPPORT = 0.9, 3
#: Up to so many disclosing terms go to every task whole; more are joined to the documents that hold them.
BROADCAST_TERMS = 2_000_000
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
MARKS = ".,;:!?()\"'"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern: its local part is the whole run before an @."""
    out, last, at = [], 0, t.find("@")
    while at >= 0:
        a = at
        while a > last and t[a - 1] in LOCAL_CHARS:
            a -= 1
        m = DOMAIN.match(t, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            last = m.end()
        at = t.find("@", max(at + 1, last))
    return out


def base_spans(t: str) -> list[tuple[str, int, int]]:
    out = [("email", *x) for x in emails(t)]
    if DIGITS.search(t):
        for m in IP.finditer(t):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(t):
            d = "".join(DIGITS.findall(m.group()))
            if len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in t:
            out += [("phone", *m.span()) for m in PHONE.finditer(t) if 10 <= len(DIGITS.findall(m.group())) <= 15]
    return out


def hash64(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


class TermHash(dict):
    """Hashes of tokens (UTF-8) as terms, 0 for what is no term or not in ``only`` (sorted); remembered up to ``most`` tokens."""

    def __init__(self, only: array | None = None, most: int = 300_000):
        super().__init__()
        self.only, self.most = only, most

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        word = token.decode().lower().strip(MARKS)
        h = xxhash.xxh64_intdigest(word) - (1 << 63) if len(word) >= 3 else 0
        if self.only is not None and h:
            i = bisect_left(self.only, h)
            h = h if i < len(self.only) and self.only[i] == h else 0
        self[token] = h
        return h

    def of(self, text: bytes) -> set[int]:
        """Of all terms of a text; bytes split at the same blanks as TOKEN, and faster."""
        return set(map(self.__getitem__, set(text.split()))) - {0}


def free_tokens(t: str, spans: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """Tokens that touch no span."""
    taken, i, end = sorted((a, b) for _, a, b in spans), 0, 0
    for m in TOKEN.finditer(t):
        while i < len(taken) and taken[i][0] < m.end():
            end = max(end, taken[i][1])
            i += 1
        if end <= m.start():
            yield m


def term_places(t: str, spans: list[tuple[str, int, int]], hashes: TermHash, own: set[int] | None = None) -> list[tuple[int, int]]:
    """Places of all terms of ``hashes``, or of those in ``own``, that touch no span."""
    wanted = {w.decode() for w in set(t.encode().split()) if (h := hashes[w]) and (own is None or h in own)}
    return [m.span() for m in free_tokens(t, spans) if m.group() in wanted] if wanted else []


def find(docs: DataFrame) -> DataFrame:
    """text (hash), entities and terms, each once, of documents that hold entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TermHash()
        for b in batches:
            same, entities, terms = [], [], []
            for key, t in zip(b.column("same").to_pylist(), b.column("text").to_pylist()):
                if t and (spans := base_spans(t)):
                    same.append(key)
                    entities.append(list({hash64(kind, t[x:y]) for kind, x, y in spans}))
                    terms.append(list(hashes.of(b" ".join({m.group().encode() for m in free_tokens(t, spans)}))))
            if same:
                yield pa.RecordBatch.from_arrays([pa.array(same, pa.int64()), pa.array(entities, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.int64()))], ["same", "entities", "terms"])

    return docs.select("text", F.xxhash64("text").alias("same")).mapInArrow(run, "same bigint, entities array<bigint>, terms array<bigint>")


def document_frequencies(docs: DataFrame, most: int = 300_000) -> DataFrame:
    """term, df over all documents; each task adds up what it reads and emits in pieces of ``most`` terms."""

    def run(batches):
        hashes = TermHash(most=most)
        counts: dict[int, int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["term", "df"])

        for b in batches:
            for t in text_bytes(b.column("text")):
                for h in hashes.of(t):
                    counts[h] = counts.get(h, 0) + 1
                if len(counts) > most:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return docs.select("text").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def disclosing(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """entity, term for every term that discloses an entity; an entity of fewer than ``support`` texts has none."""
    small_batches(docs.sparkSession)
    found = written(find(docs), "pii-found")
    each = found.select("same", F.explode("entities").alias("entity")).groupBy("entity", "same").agg(F.count("*").alias("n"))
    entities = each.groupBy("entity").agg(F.sum("n").alias("entity_df"), F.count("*").alias("texts")).where(F.col("texts") >= support).drop("texts")
    each = written(each.join(entities, "entity"), "pii-entities")
    texts = found.groupBy("same").agg(F.first("terms").alias("terms"))
    pairs = texts.join(each, "same").select("entity", "entity_df", "n", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "entity_df", "term").agg(F.sum("n").alias("both"), F.count("*").alias("texts"))
    pairs = written(pairs.where(F.col("texts") >= support), "pii-pairs")
    if pairs.isEmpty():
        return pairs.select("entity", "term")
    terms = document_frequencies(docs).join(pairs.select("term").distinct(), "term", "left_semi")
    n = F.lit(float(max(1, docs.count())))
    ic = F.log2(n / F.col("entity_df"))
    pmi = F.log2(n * F.col("both") / (F.col("df") * F.col("entity_df")))
    return written(pairs.join(terms, "term").where((ic > 0) & (pmi >= alpha * ic)).select("entity", "term"), "pii-disclosing", found, each, pairs)


def row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes of id and text, so that rows with equal ones are equal."""
    i, t = docs["doc_id"].cast("long"), docs["text"]
    return [F.xxhash64(i, t), F.xxhash64(t, F.lit(1), i)]


def held_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """k1, k2, own: the terms, out of ``terms``, that a document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TermHash()
        for b in batches:
            for k1, k2, t in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), text_bytes(b.column("text"))):
                own = list(hashes.of(t))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([k1] * len(own), [k2] * len(own), own)], ["k1", "k2", "term"])

    held = docs.select(docs["text"], *[k.alias(n) for k, n in zip(row_keys(docs), ("k1", "k2"))]).mapInArrow(run, "k1 bigint, k2 bigint, term bigint")
    return held.join(terms, "term", "left_semi").groupBy("k1", "k2").agg(F.collect_set("term").alias("own"))


def with_terms(docs: DataFrame, most: int = BROADCAST_TERMS) -> tuple[DataFrame, str, array | None]:
    """``docs`` with a new column, its name, and all disclosing terms, sorted; more than ``most`` are None, and each document has its own in that column."""
    name, k1, k2, l1, l2 = fresh(docs, "own_terms", "k1", "k2", "l1", "l2")
    found = disclosing(docs)
    terms = written(found.select("term").distinct(), "pii-terms", found)
    if terms.count() <= most:
        return docs.withColumn(name, F.lit(None).cast("array<bigint>")), name, array("q", np.sort(terms.toArrow().column("term").to_numpy()).tolist())
    own = written(held_terms(docs, terms).select(F.col("k1").alias(l1), F.col("k2").alias(l2), F.col("own").alias(name)), "pii-own", terms)
    keyed = docs.withColumns(dict(zip((k1, k2), row_keys(docs))))
    return keyed.join(own, (F.col(k1) == F.col(l1)) & (F.col(k2) == F.col(l2)), "left").drop(k1, k2, l1, l2), name, None


def places(b: pa.RecordBatch, hashes: TermHash, name: str) -> Iterator[tuple[list, list]]:
    """Base spans and places of terms of every row."""
    whole = hashes.only is not None
    for t, own in zip(b.column("text").to_pylist(), b.column(name).to_pylist()):
        spans = base_spans(t or "")
        none = not len(hashes.only) if whole else not own
        yield spans, [] if none or not t else term_places(t, spans, hashes, None if whole else set(own))


def detect(docs: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """doc_id, base and terms of every document."""
    keyed, name, known = with_terms(docs.select("doc_id", "text"), most)
    span = pa.struct([("a", pa.int32()), ("b", pa.int32())])
    hashes = TermHash(known)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        bases, terms = [], []
        for spans, at in places(b, hashes, name):
            bases.append([{"kind": k, "a": x, "b": y} for k, x, y in spans])
            terms.append([{"a": x, "b": y} for x, y in at])
        base = pa.array(bases, pa.list_(pa.struct([("kind", pa.string()), *span])))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), base, pa.array(terms, pa.list_(span))], ["doc_id", "base", "terms"])

    rows = keyed.select(keyed["doc_id"].cast("long").alias("doc_id"), "text", name)
    return map_batches(rows, batch, "doc_id bigint, base array<struct<kind:string,a:int,b:int>>, terms array<struct<a:int,b:int>>")


def all_spans(base: list, terms: list | None) -> list[tuple[str, int, int]]:
    """Base spans, and places of terms, which touch none of them."""
    return [(x["kind"], x["a"], x["b"]) for x in base] + [("term", x["a"], x["b"]) for x in terms or ()]


def report(found: DataFrame) -> DataFrame:
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(6)]
        for base, terms in zip(b.column("base").to_pylist(), b.column("terms").to_pylist()):
            spans = all_spans(base, terms)
            own = [x for x in spans if x[0] != "term"]
            for c, x in zip(cols, [*[sum(k == kind for k, _, _ in own) for kind in KINDS[:4]], sha(joined(own, KINDS)), joined(spans, KINDS)]):
                c.append(x)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", *names])

    return map_batches(found.select("doc_id", "base", "terms"), batch, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def sanitise(docs: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """``docs`` with the same columns: n_chars follows the text. In ``text``, entities give way to the name of their kind and disclosing terms to [TERM]."""
    keyed, name, known = with_terms(docs, most)
    rest = docs.columns
    hashes = TermHash(known)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for t, (base, terms) in zip(b.column("text").to_pylist(), places(b, hashes, name)):
            spans = base + [("term", x, y) for x, y in terms]
            texts.append(redact(t, spans) if spans else t)
        new = {"text": texts, "n_chars": [None if t is None else len(t) for t in texts]}
        cols = [pa.array(new[c], b.schema.field(c).type) if c in new else b.column(c) for c in rest]
        return pa.RecordBatch.from_arrays(cols, rest)

    return map_batches(keyed.select(*[F.col(f"`{c}`") for c in [*rest, name]]), batch, docs.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(detect(table(spark, sf_dir, "documents")))
