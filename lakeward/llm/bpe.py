"""BPE encoding and decoding by forced-boundary splitting.

A merge only ever builds vocabulary tokens, so two neighbouring symbols that
stand next to each other inside no token can never be merged across: the
place between them is a certain cut.  White space and special tokens are
certain cuts as well.  The fragments between cuts are encoded independently and
concatenated; a word is encoded once while it is cached.  The words that a
slice of texts brings are merged side by side: a round merges the best pair of
every fragment that has one.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lakeward.llm.common import row_slices, text_buffers

CACHE_BYTES = 48 << 20  # of memory that the words of a worker's cache take
ENTRY_BYTES = 200  # of one of them, beside its letters and ids
# texts of these are already composed; their lower case does not depend on context
_PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7e\xa1-\u012f\u0131-\u017f]*")
_BLANKS = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


class ForcedBoundaryBpe:
    """Byte-pair model with word ends, read from a tokenizer JSON file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        tok = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tok.normalizer, tok.pre_tokenizer
        rule = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split_plain = regex.compile(rule).findall
        self.bytes = {b: self.splitter.pre_tokenize_str(chr(b))[0][0] for b in range(33, 127)} | self._high_bytes()
        self.words: dict[str, bytes] = {}  # words met lately, and those met before
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.inside = set()
        for t in self.ids:
            s = self.symbols(t[:-len(self.end)], True) if t.endswith(self.end) and t != self.end else list(t)
            self.inside.update(zip(s, s[1:]))
        self._tables(pairs)
        top = max(self.names) + 1
        self.tokens = pa.array([self.names.get(i, "") for i in range(top)], pa.large_string())

    def _tables(self, pairs: list[tuple[str, str]]) -> None:
        """The model as arrays: ids of bytes inside and at the end of a word,
        pairs that stand inside a token, and merges, sorted by pair."""
        self.inner = np.array([self.ids.get(self.bytes.get(b), -1) for b in range(256)], np.int64)
        self.final = np.array([self.ids.get(self.bytes[b] + self.end, -1) if b in self.bytes else -1 for b in range(256)], np.int64)
        held = [(self.ids[a], self.ids[b]) for a, b in self.inside if a in self.ids and b in self.ids]
        self.inside_codes = np.sort(np.array([a << 20 | b for a, b in held], np.int64))
        codes = np.array([self.ids[a] << 20 | self.ids[b] for a, b in pairs], np.int64)
        order = np.argsort(codes, kind="stable")
        self.merge_codes, self.merge_ranks = codes[order], order
        self.merged = np.array([self.ids[a + b] for a, b in pairs], np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs; len(merged) for pairs that don't merge."""
        code = left << 20 | right
        at = np.minimum(np.searchsorted(self.merge_codes, code), len(self.merge_codes) - 1)
        return np.where(self.merge_codes[at] == code, self.merge_ranks[at], len(self.merged))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of lower-cased words."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.concatenate(([0], np.cumsum(size)))
        sym = self.inner[data]
        sym[starts[1:] - 1] = self.final[data[starts[1:] - 1]]
        # fragments: from a word's start, or a certain cut, to the next
        code = sym[:-1] << 20 | sym[1:]
        at = np.minimum(np.searchsorted(self.inside_codes, code), len(self.inside_codes) - 1)
        cut = np.concatenate(([True], self.inside_codes[at] != code))
        cut[starts[:-1]] = True
        frag = np.cumsum(cut) - 1
        word_of = np.repeat(np.arange(len(words)), size)[cut]
        none = len(self.merged)
        rank = np.full(len(sym), none)  # of a symbol and the next of its fragment
        rank[:-1] = np.where(cut[1:], none, self._ranks(sym[:-1], sym[1:]))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            head = np.flatnonzero(np.concatenate(([True], frag[1:] != frag[:-1])))
            length = np.diff(np.append(head, len(sym)))
            best = np.minimum.reduceat(rank, head)
            on = np.repeat(best < none, length)
            if not on.all():
                done.append((frag[~on], sym[~on]))
                sym, frag, rank, best = sym[on], frag[on], rank[on], np.repeat(best, length)[on]
                if not len(sym):
                    break
            else:
                best = np.repeat(best, length)
            p = np.flatnonzero(rank == best)
            p = p[np.concatenate(([True], frag[p[1:]] != frag[p[:-1]]))]  # the leftmost of each fragment
            sym[p] = self.merged[rank[p]]
            keep = np.ones(len(sym), bool)
            keep[p + 1] = False
            sym, frag, rank = sym[keep], frag[keep], rank[keep]
            p -= np.arange(len(p))  # where the merged symbols are now
            touched = np.concatenate((p, p[p > 0] - 1))
            after = np.minimum(touched + 1, len(sym) - 1)
            same = (after > touched) & (frag[touched] == frag[after])
            rank[touched] = np.where(same, self._ranks(sym[touched], sym[after]), none)
        frags, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(frags, kind="stable")
        packed = ids[order].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word_of[frags], minlength=len(words))) * 4
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _high_bytes(self) -> dict[int, str]:
        """Symbols of the bytes beyond ASCII, taken from characters that hold them."""
        out = {}
        for c in map(chr, (*range(0xA1, 0x180), *range(0x370, 0x600), *range(0x900, 0xE80, 7))):
            got = self.splitter.pre_tokenize_str(c)
            if got and len(got[0][0]) == len(c.encode()):
                out.update(zip(c.encode(), got[0][0]))
        return out

    def symbols(self, word: str, ends: bool) -> list[str]:
        s = list(word)
        if ends and s:
            s[-1] += self.end
        return s

    def merge(self, s: list[str]) -> list[str]:
        """Merges by rank, leftmost first; long fragments in O(n log n)."""
        n, rank = len(s), self.rank
        if n <= 64:
            get, none = rank.get, len(rank)
            ranks = [get(p, none) for p in zip(s, s[1:])]
            while ranks:
                best = min(ranks)
                if best == none:
                    break
                i = ranks.index(best)
                s[i] += s[i + 1]
                del s[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = get((s[i - 1], s[i]), none)
                if i < len(ranks):
                    ranks[i] = get((s[i], s[i + 1]), none)
            return s
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := rank.get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or s[i] != a or s[j] != b:
                continue
            s[i], alive[j], after[i] = a + b, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank.get((s[i], s[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, s[i], s[after[i]]))
            p = before[i]
            if p >= 0 and (r := rank.get((s[p], s[i]))) is not None:
                heapq.heappush(heap, (r, p, s[p], s[i]))
        return [x for x, y in zip(s, alive) if y]

    def learn(self, words: set[str]) -> None:
        """Caches words.  The cache is two halves: a full newer one becomes
        the older, whose words move back when they are met again."""
        new = []
        for w in words:
            if (packed := self.older.get(w)) is None:
                new.append(w)
            else:
                self._put(w, packed)
        short = [w for w in new if len(w) <= 64]
        for a in range(0, len(short), 20_000):
            for w, packed in zip(short[a:a + 20_000], self.encode_words(short[a:a + 20_000])):
                self._put(w, packed)
        for w in new:
            if len(w) > 64:
                self._put(w, self.encode_word(w if w.isascii() else "".join([self.bytes[b] for b in w.encode()])))

    def _put(self, word: str, packed: bytes) -> None:
        self.words[word] = packed
        self.held += ENTRY_BYTES + len(word) + len(packed)

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """Packed ids of plain texts without special tokens."""
        if self.held > CACHE_BYTES // 2:
            self.older, self.words, self.held = self.words, {}, 0
        split = [self.split_plain(t.lower()) for t in texts]
        known = self.words
        self.learn(set().union(*[set(ws).difference(known) for ws in split]))
        return [b"".join(map(known.__getitem__, ws)) for ws in split]

    def encode_word(self, word: str) -> bytes:
        """Packed ids of one pre-token, given in the byte alphabet."""
        s, out, a = self.symbols(word, True), [], 0
        ids, inside = self.ids, self.inside
        for k, pair in enumerate(zip(s, s[1:]), 1):
            if pair not in inside:
                out += [ids[t] for t in self.merge(s[a:k])]
                a = k
        out += [ids[t] for t in self.merge(s[a:])]
        return struct.pack(f"<{len(out)}I", *out)

    def encode_other(self, text: str) -> bytes:
        """Packed ids of a text with special tokens or characters that are
        not plain: run by run between blanks."""
        out: list[bytes] = []
        at = 0
        for m in [*self.special_at.finditer(text), None]:
            part = text[at:m.start()] if m else text[at:]
            for run in part.translate(_BLANKS).split(" "):
                if _PLAIN.fullmatch(run):
                    out += self.encode_plain([run])
                else:
                    out += [self.encode_word(w) for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(run))]
            if m:
                out.append(struct.pack("<I", self.special[m[0]]))
                at = m.end()
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian ids of each text."""
        plain = [_PLAIN.fullmatch(t) is not None and self.special_at.search(t) is None for t in texts]
        done = iter(self.encode_plain([t for t, p in zip(texts, plain) if p]))
        return [next(done) if p else self.encode_other(t) for t, p in zip(texts, plain)]

    def decode_all(self, packed: list[bytes]) -> pa.Array:
        """Per row its token strings joined by a blank (these files name no decoder)."""
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int64)
        rows = pa.LargeListArray.from_arrays(pa.array(offsets), self.tokens.take(pa.array(ids)))
        return pc.binary_join(rows, pa.scalar(" ", pa.large_string()))


_MODELS: dict[str, ForcedBoundaryBpe] = {}


def model(path: str) -> ForcedBoundaryBpe:
    """One model per worker process."""
    if path not in _MODELS:
        _MODELS[path] = ForcedBoundaryBpe(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``id_col``, the columns in ``keep``, n_tokens, ids (packed
    unsigned 32-bit little-endian) and decoded.

    ``path`` names a tokenizer file that every executor can read.  A null or
    empty text gives no ids and an empty decoded text; rows that repeat are
    encoded each; an empty table gives an empty result.  One narrow pass: no
    shuffle, memory bounded by a batch and the cache; a lost executor costs
    its own partitions only."""
    cols = [id_col, *keep]
    schema = T.StructType([docs.schema[c] for c in cols] + [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            texts = batch.column(len(cols))
            for a, b in row_slices(text_buffers(texts)[1], 2 << 20):
                gc.disable()  # the caches hold no cycles; scanning them costs a third of the time
                try:
                    got = bpe.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
                finally:
                    gc.enable()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, b - a) for i in range(len(cols))]
                    + [pa.array([len(g) // 4 for g in got], pa.int64()), pa.array(got, pa.binary()), bpe.decode_all(got).cast(pa.string())],
                    names=[*cols, "n_tokens", "ids", "decoded"])

    return docs.select(*cols, docs[text_col].alias("_bpe_text")).mapInArrow(run, schema)
