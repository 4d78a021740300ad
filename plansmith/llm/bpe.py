"""Operator 9: BPE encoding and decoding with a contiguous rank array.

A text is cut at ASCII white space, which no step of the tokenizer joins; each distinct chunk is normalised, pre-tokenised
and merged once and kept in a bounded memo.  The merge loop holds, for words of equal length, one row a word: the parts and
the rank of each adjacent pair side by side.  It looks for the smallest rank, deletes that boundary, and refreshes the two
neighbouring ranks, for all words at once.  Words over LONG bytes use a heap, as the row scan is quadratic.

Cases: a null or empty text has no tokens; the strings of special tokens inside a text become those tokens, as in the
tokenizers library; texts of any length are encoded whole; repeated rows give repeated results; of pairs of equal rank
the leftmost merges first; an empty table gives no rows; input columns other than doc_id, text and those of `keep` are
neither read nor passed on, so they may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.normalizers import NFC

from .text import slices

#: Unicode's White_Space.
BLANK = "\t\n\v\f\r \x85\xa0  -     　"
LONG = 96
NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class Newer:
    """What the library knows of letters that Python's Unicode does not have yet: their kind and their lower case.

    All planes that have letters are asked at once, each letter between two others and behind a sign."""

    def __init__(self, path: str):
        library = Tokenizer.from_file(path)
        new = [chr(c) for c in [*range(0x40000), *range(0xE0000, 0xE1000)] if unicodedata.category(chr(c)) == "Cn"]
        low = library.normalizer.normalize_str(" ".join(new)).split(" ")
        self.lower = {ord(a): b for a, b in zip(new, low, strict=True) if a != b} if len(low) == len(new) else {}
        self.kind: dict[int, str] = {}
        for form, kind in (("a{}b", "L"), ("!{}!", "N")):
            spans = {at for _, at in library.pre_tokenizer.pre_tokenize_str(" ".join(form.format(c) for c in new))}
            for k, c in enumerate(new):
                # A letter keeps its neighbours in one word; a number stands alone even among signs.
                if ((4 * k, 4 * k + 3) if kind == "L" else (4 * k + 1, 4 * k + 2)) in spans:
                    self.kind.setdefault(ord(c), kind)


def category(kind: str, newer: dict[int, str]) -> str:
    """The ranges of a Unicode category, for a character class."""
    out, since = [], None
    for c in range(sys.maxunicode + 2):
        own = c <= sys.maxunicode and newer.get(c, unicodedata.category(chr(c))[0]) == kind
        if own and since is None:
            since = c
        elif not own and since is not None:
            out.append(f"\\U{since:08x}-\\U{c - 1:08x}")
            since = None
    return "".join(out)


COMPOSED = NFC().normalize_str


def plain(text: str, newer: dict[int, str]) -> str:
    """NFC (the library's own, as its Unicode is another than Python's), then lower case letter by letter: a capital sigma never becomes a final one."""
    if text.isascii():
        return text.lower()
    return COMPOSED(text).replace("\u03a3", "\u03c3").lower().translate(newer)


class WordBpe:
    """A word-end BPE vocabulary of the tokenizers library's JSON, merged by our own code."""

    def __init__(self, path: str, memo: int = 750_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in pre]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or model.get("byte_fallback") or spec["post_processor"] or spec["decoder"]:
            raise ValueError(f"{path}: not a word-end byte-level BPE of the kind this encoder knows")
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError(f"{path}: special tokens with options")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.token = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        replace = spec["normalizer"]["normalizers"][1]
        if (replace["pattern"], replace["content"]) != ({"Regex": r"\s+"}, " "):
            raise ValueError(f"{path}: white space is replaced in another way")
        newer = Newer(path)
        self.lower = newer.lower
        rule = pre[0]["pattern"]["Regex"].replace(r"[^\s", f"[^{BLANK}").replace(r"\p{L}", category("L", newer.kind)).replace(r"\p{N}", category("N", newer.kind))
        self.words, self.lines = re.compile(rule), re.compile(rule + "|\n")
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.size = max(self.token) + 1
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys = key[order]
        self.rank = order.astype(np.int32)
        self.into = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.most = memo
        self.memo: dict[bytes, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merged(self, words: np.ndarray) -> list[np.ndarray]:
        """words: bytes of equally long words, one a row."""
        parts = self.inner[words]
        parts[:, -1] = self.last[words[:, -1]]
        n, size = parts.shape
        left, row = np.full(n, size), np.arange(n)
        rank = np.full((n, size), NONE, np.int32)
        if size > 1:
            rank[:, :-1] = self.ranks(parts[:, :-1], parts[:, 1:])
        out: list[np.ndarray | None] = [None] * n
        columns = np.arange(size)
        while n:
            at = rank.argmin(axis=1)  # the leftmost of equals
            best = rank[np.arange(n), at]
            if (done := best == NONE).any():
                for i in np.flatnonzero(done):
                    out[row[i]] = parts[i, : left[i]]
                live = ~done
                parts, rank, left, row, at, best = parts[live], rank[live], left[live], row[live], at[live], best[live]
                if not (n := len(row)):
                    break
            here = np.arange(n)
            parts[here, at] = self.into[best]
            gone = columns[:-1] + (columns[:-1] > at[:, None])
            parts[:, :-1] = np.take_along_axis(parts, gone, 1)
            shift = columns[:-1] + (columns[:-1] >= at[:, None])
            rank[:, :-1] = np.take_along_axis(rank, shift, 1)
            rank[:, -1] = NONE
            left -= 1
            rank[here, at] = NONE
            if (more := at + 1 < left).any():
                rank[here[more], at[more]] = self.ranks(parts[here[more], at[more]], parts[here[more], at[more] + 1])
            if (more := at > 0).any():
                rank[here[more], at[more] - 1] = self.ranks(parts[here[more], at[more] - 1], parts[here[more], at[more]])
        return out

    def long(self, word: bytes) -> np.ndarray:
        """The same merges by a heap of (rank, place) over a linked list."""
        b = np.frombuffer(word, np.uint8)
        ids = self.inner[b]
        ids[-1] = self.last[b[-1]]
        first, ids = self.ranks(ids[:-1], ids[1:]).tolist(), ids.tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b_ = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b_:
                continue
            ids[i], ids[j], after[i] = int(self.into[r]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := int(self.ranks(np.array([ids[x]]), np.array([ids[y]]))[0])) != NONE:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def pieces(self, chunk: bytes) -> list[bytes | int]:
        """The words of a chunk that holds special tokens, and those tokens' ids."""
        text, out, at = chunk.decode("utf-8", "replace"), [], 0
        for m in [*self.cut.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            out += [w.encode() for w in self.words.findall(plain(part, self.lower))]
            if m:
                out.append(self.special[m[0]])
                at = m.end()
        return out

    def learn(self, chunks: set[bytes]) -> None:
        """Put chunks in the memo: ids as little-endian uint32."""
        odd = [c for c in chunks if b"<|" in c]
        own = [c for c in chunks if b"<|" not in c]
        cut: list[list[bytes | int]] = [[]]
        # One pass over all chunks: a line feed, which no chunk holds, parts them.
        for w in self.lines.findall(plain(b"\n".join(own).decode("utf-8", "replace"), self.lower)):
            if w == "\n":
                cut.append([])
            else:
                cut[-1].append(w.encode())
        cut = cut[: len(own)] + [self.pieces(c) for c in odd]
        words = {w for x in cut for w in x if isinstance(w, bytes)}
        by: dict[int, list[bytes]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        ids: dict[bytes | int, bytes] = {}
        for size, some_size in by.items():
            if size > LONG:
                ids.update((w, self.long(w).astype("<u4").tobytes()) for w in some_size)
                continue
            for k in range(0, len(some_size), 1 << 14):
                some = some_size[k : k + (1 << 14)]
                got = self.merged(np.frombuffer(b"".join(some), np.uint8).reshape(-1, size))
                ids.update((w, x.astype("<u4").tobytes()) for w, x in zip(some, got, strict=True))
        ids.update((i, np.uint32(i).tobytes()) for i in self.special.values())
        for c, x in zip(own + odd, cut, strict=True):
            self.memo[c] = b"".join([ids[w] for w in x])

    def encode(self, texts: list[bytes]) -> Iterator[tuple[list[bytes], bytes]]:
        """The chunks of each text and its ids as little-endian uint32."""
        split = [t.split() for t in texts]
        own = set(chain.from_iterable(split))
        if len(self.memo) > self.most:  # keep what is in use
            self.memo = {c: self.memo[c] for c in own if c in self.memo}
        if new := own.difference(self.memo):
            self.learn(new)
        get = self.memo.__getitem__
        for chunks in split:
            yield chunks, b"".join(map(get, chunks))

    def decode(self, ids: bytes) -> bytes:
        """Tokens joined by spaces: what the library does for a vocabulary without a decoder."""
        token = self.token
        return " ".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()]).encode()


LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in LOADED:
        LOADED[path] = WordBpe(path)
    return LOADED[path]


def encode_decode(docs: DataFrame, path: str, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids (binary, little-endian uint32) and decoded text of every row, with the id and the columns of `keep`."""
    keep = [c for c in keep or [] if c not in ("n_tokens", "ids", "decoded", id_col)]
    out = [docs.schema[id_col], *(docs.schema[c] for c in keep)]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", n_tokens bigint, ids binary, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, tokens = loaded(path), {}
        for batch in batches:
            for b in slices(batch, text_col):
                texts = [x or b"" for x in b.column(b.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()]
                ids, decoded = [], []
                if len(tokens) > bpe.most:
                    tokens.clear()
                for chunks, x in bpe.encode(texts):
                    ids.append(x)
                    try:
                        shown = list(map(tokens.__getitem__, chunks))
                    except KeyError:
                        for c in chunks:
                            if c not in tokens:
                                tokens[c] = bpe.decode(bpe.memo[c])
                        shown = list(map(tokens.__getitem__, chunks))
                    decoded.append(b" ".join(filter(None, shown)))
                columns = [b.column(b.schema.get_field_index(f.name)) for f in out]
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, n, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], [*(f.name for f in out), "n_tokens", "ids", "decoded"])

    return docs.select(id_col, *keep, text_col).mapInArrow(run, ddl)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded text, hashed where they are made."""
    from pyspark.sql import functions as F

    return encode_decode(docs, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
