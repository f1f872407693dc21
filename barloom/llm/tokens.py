"""Token counts and ids of a byte-level BPE vocabulary.

The vocabulary file's path is a parameter. ``Encoder`` gives ids; ``PrefixCounter`` stores the exact
token count at every prefix by dynamic programming, and answers truncation and budget questions from it.

For every prefix of a pre-token exactly one token t ends its encoding: the one for which t stays
next to the last token of the prefix before it. So count[p] = count[p - len(t)] + 1, and no prefix is encoded again.

``prefix_table`` stores the counts of all prefixes with the documents, one byte or two a character; ``truncated`` and ``tokens_within`` answer from it.

Defined results: a null text counts as empty and has 0 tokens; strings of special tokens inside a text become these tokens,
as the tokenizer library does by default; a null id is kept; repeated rows give repeated results; an empty table gives an empty result; very long texts are counted
whole; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table

VOCABULARY = "byte_bpe_50k.json"
#: The pre-tokenizer's pattern of this family of vocabularies (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FINE = regex.compile(PATTERN)
#: Coarser pieces whose borders are always borders of pre-tokens.
COARSE = regex.compile(r" ?\S+|\s+(?!\S)|\s")
BLANK = regex.compile(r"\s")
#: Pieces up to so many bytes are worked on together, longer ones by themselves.
SHORT = 48


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 characters stand for themselves, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        back = byte_of_char()
        self.special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        self.ids = {bytes(back[c] for c in k): v for k, v in data["model"]["vocab"].items() if k not in self.special}
        size = max(self.ids.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for k, v in self.ids.items():
            self.bytes_of[v] = k
        self.length = np.array([len(x) for x in self.bytes_of], np.int64)
        # The merge that made each token; a single byte is its own half.
        self.left, self.right, self.rank = np.arange(size), np.arange(size), np.full(size, -1)
        keys = []
        for r, m in enumerate(data["model"]["merges"]):
            a, b = (m if isinstance(m, list) else m.split(" "))
            x, y = (self.ids[bytes(back[c] for c in s)] for s in (a, b))
            z = self.ids[self.bytes_of[x] + self.bytes_of[y]]
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, r
            keys.append((x << 20 | y, r))
        keys.sort()
        self.pair_key = np.array([k for k, _ in keys] + [1 << 62], np.int64)
        self.pair_rank = np.array([r for _, r in keys] + [0], np.int64)
        # Hashes of the tokens' bytes, to look many strings up at a time.
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.lengths = np.array(sorted({len(k) for k in self.ids}), np.int64)
        self.power = np.ones(int(self.lengths[-1]) + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(1, len(self.power)):
                self.power[i] = self.power[i - 1] * self.base
            hashes = np.array([self.hash(k) for k in self.ids], np.uint64)
            order = np.argsort(hashes)
            self.token_hash, self.token_id = hashes[order], np.fromiter(self.ids.values(), np.int64)[order]
            self.maybe = np.zeros(1 << 22, bool)
            self.maybe[(hashes * self.base) >> np.uint64(42)] = True
            self.maybe_pair = np.zeros(1 << 22, bool)
            self.maybe_pair[(self.pair_key.astype(np.uint64) * self.base) >> np.uint64(42)] = True
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def split_special(self, text: str) -> list[str | int]:
        """Ordinary parts of a text, and ids of the special tokens between them."""
        if not self.special_pattern or not any(s in text for s in self.special):
            return [text]
        out: list[str | int] = []
        at = 0
        for m in self.special_pattern.finditer(text):
            out += [text[at : m.start()], self.special[m.group()]]
            at = m.end()
        return [*out, text[at:]]

    def hash(self, token: bytes) -> int:
        h = 0
        for b in token:
            h = (h * int(self.base) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def token_of(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.token_hash, hashes), len(self.token_hash) - 1)
        return np.where(self.token_hash[at] == hashes, self.token_id[at], -1)

    def pair(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or a number over all ranks."""
        key = (x << 20) | y
        out = np.full(len(key), 1 << 40)
        some = np.flatnonzero(self.maybe_pair[(key.astype(np.uint64) * self.base) >> np.uint64(42)])
        at = np.searchsorted(self.pair_key, key[some])
        out[some] = np.where(self.pair_key[at] == key[some], self.pair_rank[at], 1 << 40)
        return out

    def stays(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether tokens x and y, each the encoding of its bytes, stay as they are side by side.

        Undo merges on both sides of the border, the latest first; a border that two halves would have
        crossed before one of them was merged further is no border.
        """
        ok = np.ones(len(x), bool)
        live = np.arange(len(x))
        x, y = x.copy(), y.copy()
        limit = np.full(len(x), 1 << 39)
        while len(live):
            crossed = self.pair(x, y) < limit
            ok[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            keep = ~crossed & ((rx >= 0) | (ry >= 0))
            live, x, y, limit, rx, ry = live[keep], x[keep], y[keep], limit[keep], rx[keep], ry[keep]
            first = rx > ry
            # A merge on the left of the border wins a tie of ranks, so one on the right may be tied by the border's own.
            limit = np.where(first, rx, ry + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return ok


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def automaton(path: str) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, v in vocabulary(path).ids.items():
        a.add_word(k.decode("latin-1"), v)
    a.make_automaton()
    return a


class Encoder:
    """Ids of whole texts. The merges run in a compiled library over the same vocabulary."""

    def __init__(self, path: str | None = None):
        import tiktoken

        self.vocabulary = v = vocabulary(path or default_path())
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=v.ids, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        parts = [[p] if isinstance(p, int) else self.core.encode_ordinary(p) for p in self.vocabulary.split_special(text) if p != ""]
        return np.array([i for p in parts for i in p] if len(parts) != 1 else parts[0], np.uint32)


class PrefixCounter:
    """Exact token counts at prefixes; counts of at most ``most`` pieces are remembered."""

    def __init__(self, path: str | None = None, most: int = 800_000):
        self.path, self.most = path or default_path(), most
        self.known: dict[str, int] = {}

    @property
    def vocabulary(self) -> Vocabulary:
        return vocabulary(self.path)

    def table(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, starts): counts[starts[i] + p] is the token count of the first p bytes of words[i], each at most SHORT bytes."""
        v = self.vocabulary
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - sizes - 1
        raw = np.frombuffer(b"\0".join([*words, b""]), np.uint8).astype(np.uint64) + np.uint64(1)
        count, last = np.zeros(len(raw) + 1, np.int32), np.full(len(raw) + 1, -1, np.int64)
        h = np.zeros(len(raw) + 1, np.uint64)  # of each prefix, as a polynomial over its bytes
        order = np.argsort(-sizes, kind="stable")
        at, n = starts[order], len(order)
        tall = sizes[order]
        for p in range(1, int(tall[0]) + 1 if n else 1):
            n = int(np.searchsorted(-tall, -p, side="right"))
            g = at[:n] + p
            h[g] = h[g - 1] * v.base + raw[g - 1]
            for size in v.lengths[v.lengths <= p][::-1].tolist():
                sub = h[g] - h[g - size] * v.power[size]
                hit = np.flatnonzero(v.maybe[(sub * v.base) >> np.uint64(42)])
                if not len(hit):
                    continue
                t = v.token_of(sub[hit])
                hit, t = hit[t >= 0], t[t >= 0]
                before = last[g[hit] - size]
                rest = np.flatnonzero(before >= 0)
                good = np.ones(len(hit), bool)
                good[rest] = v.stays(before[rest], t[rest])
                hit, t = hit[good], t[good]
                last[g[hit]] = t
                count[g[hit]] = count[g[hit] - size] + 1
                left = np.ones(len(g), bool)
                left[hit] = False
                g = g[left]
                if not len(g):
                    break
        return count, starts

    def long_counts(self, word: bytes) -> np.ndarray:
        """The same for one word of any length."""
        v = self.vocabulary
        count, last = np.zeros(len(word) + 1, np.int32), [-1] * (len(word) + 1)
        known: dict[tuple[int, int], bool] = {}
        matches = automaton(self.path).iter(word.decode("latin-1"))
        ends, at = [], -1

        def settle() -> None:
            for t in ends:
                i = at + 1 - len(v.bytes_of[t])
                s = last[i]
                ok = s < 0
                if not ok:
                    ok = known.get((s, t))
                    if ok is None:
                        ok = known[s, t] = bool(v.stays(np.array([s]), np.array([t]))[0])
                if ok:
                    last[at + 1], count[at + 1] = t, count[i] + 1
                    return

        for end, t in matches:
            if end != at:
                if at >= 0:
                    settle()
                ends, at = [], end
            ends.append(t)
        if at >= 0:
            settle()
        return count

    def word_counts(self, words: list[bytes]) -> list[np.ndarray]:
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        count, starts = self.table([words[i] for i in short])
        out = [np.zeros(0)] * len(words)
        for k, i in enumerate(short):
            out[i] = count[starts[k] : starts[k] + len(words[i]) + 1]
        for i, w in enumerate(words):
            if len(w) > SHORT:
                out[i] = self.long_counts(w)
        return out

    def learn(self, pieces: set[str]) -> None:
        """Fill in the token counts of coarse pieces."""
        if len(self.known) + len(pieces) > self.most:
            self.known.clear()
        todo = list(pieces)
        fine = [[p] if p.isalpha() or p[0] == " " and p[1:].isalpha() else FINE.findall(p) for p in todo]
        words = [w.encode() for f in fine for w in f]
        short = np.array([len(w) <= SHORT for w in words], bool)
        count, starts = self.table([w for w, s in zip(words, short) if s])
        sizes = np.array([len(w) for w, s in zip(words, short) if s], np.int64)
        total = np.zeros(len(words), np.int64)
        total[short] = count[starts + sizes] if len(sizes) else 0
        for i in np.flatnonzero(~short):
            total[i] = self.long_counts(words[i])[-1]
        edge = np.cumsum([0] + [len(f) for f in fine])
        sums = np.concatenate(([0], np.cumsum(total)))
        self.known.update(zip(todo, (sums[edge[1:]] - sums[edge[:-1]]).tolist()))

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts."""
        pieces: list[list[str]] = []
        special: list[int] = []
        for t in texts:
            parts = self.vocabulary.split_special(t)
            special.append(sum(isinstance(p, int) for p in parts))
            pieces.append([x for p in parts if isinstance(p, str) for x in COARSE.findall(p)])
        out: list[int] = []
        at = 0
        while at < len(texts):  # as many texts at a time as the memory of pieces allows
            new: set[str] = set()
            to = at
            while to < len(texts) and (to == at or len(new) + len(pieces[to]) <= self.most // 2):
                new.update(pieces[to])
                to += 1
            new -= self.known.keys()
            if new:
                if len(self.known) + len(new) > self.most:
                    new = set().union(*pieces[at:to])
                    self.known.clear()
                self.learn(new)
            out += [sum(map(self.known.__getitem__, pieces[i])) + special[i] for i in range(at, to)]
            at = to
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of every prefix of ``text``, by number of code points from 0 to all."""
        out = [0]
        total = 0
        for part in self.vocabulary.split_special(text):
            if isinstance(part, int):
                name = next(k for k, v in self.vocabulary.special.items() if v == part)
                before = text[: len(out) - 1].rpartition(name)[2]  # cut inside, a special string is ordinary text
                done = total - self.counts([before])[0]
                out += [done + self.counts([before + name[:i]])[0] for i in range(1, len(name))] + [total + 1]
                total += 1
                continue
            words = FINE.findall(part)
            for i, (w, c) in enumerate(zip(words, self.word_counts([w.encode() for w in words]))):
                b, own = 0, []
                for ch in w:
                    b += len(ch.encode())
                    own.append(total + int(c[b]))
                if w in ("'re", "'ve", "'ll"):  # cut after one letter, it is no contraction yet
                    own[1] = total + 2
                if i and BLANK.match(w) and BLANK.match(words[i - 1], len(words[i - 1]) - 1):  # cut there, the blank still belongs to the run before it
                    run = words[i - 1]
                    own[0] = out[len(out) - 1 - len(run)] + int(self.word_counts([(run + w[0]).encode()])[0][-1])
                out += own
                total += int(c[-1])
        return np.array(out, np.int64)

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens."""
        fits = np.flatnonzero(self.prefixes(text) <= budget)
        return text[: fits[-1]] if len(fits) else ""


def count_tokens(docs: DataFrame, limit: int = 1024, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text."""
    counter = PrefixCounter(path)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in b.column("text").to_pylist()]
        n = counter.counts(texts)
        size = [len(t.encode()) for t in texts]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), batch, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def packed_steps(counts: np.ndarray) -> bytes:
    """Steps from prefix to prefix as signed bytes, or as 16 or 64 bits after a mark, where one is larger."""
    d = np.diff(counts)
    for mark, kind in ((b"1", np.int8), (b"2", np.int16)):
        if not len(d) or (np.iinfo(kind).min <= d.min() and d.max() <= np.iinfo(kind).max):
            return mark + d.astype(kind).tobytes()
    return b"8" + d.astype(np.int64).tobytes()


def unpacked(steps: bytes) -> np.ndarray:
    """Token counts of every prefix, from 0 characters on."""
    kind = {b"1": np.int8, b"2": np.int16, b"8": np.int64}[steps[:1]]
    return np.concatenate(([0], np.cumsum(np.frombuffer(steps[1:], kind).astype(np.int64))))


def prefix_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text, steps: the token counts of every prefix, to be written and asked later."""
    counter = PrefixCounter(path)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        steps = [packed_steps(counter.prefixes(t or "")) for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(steps, pa.binary())], ["doc_id", "text", "steps"])

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), batch, "doc_id bigint, text string, steps binary")


def truncated(stored: DataFrame, budget: int) -> DataFrame:
    """doc_id, text, n_tokens: the longest prefix of at most ``budget`` tokens, from stored counts; a null text stays."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, sizes = [], []
        for t, s in zip(b.column("text").to_pylist(), b.column("steps").to_pylist()):
            c = unpacked(s)
            at = int(np.flatnonzero(c <= budget)[-1])
            texts.append(None if t is None else t[:at])
            sizes.append(int(c[at]))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["doc_id", "text", "n_tokens"])

    return map_batches(stored.select("doc_id", "text", "steps"), batch, "doc_id bigint, text string, n_tokens bigint")


def tokens_within(stored: DataFrame, characters: int) -> DataFrame:
    """doc_id, n_tokens of each text's first ``characters`` characters, from stored counts."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        n = [int(c[min(characters, len(c) - 1)]) for c in map(unpacked, b.column("steps").to_pylist())]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return map_batches(stored.select("doc_id", "steps"), batch, "doc_id bigint, n_tokens bigint")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
