"""Operator 2: token ids in files of Simple-8b words.

A 64-bit word has a 4-bit selector and as many ids as that selector's width lets in.  Ids are cut into blocks of BLOCK;
each block starts a word, and its word offset is stored, so all blocks decode side by side.  An id of 60 bits or more (or
2**60 - 1, the mark itself) is escaped: a word of ones under selector 15, then the id as it is.

A file is MAGIC and segments, each of whole rows: a head of five uint64 (rows, ids, words, blocks, escapes), then the rows'
ids (int64) and null flags (uint8), their lengths (uint64), the blocks' word offsets (uint64), the escapes' word indexes
(uint64) and the words (uint64), all little-endian.

Cases: a null or empty text is its end id alone; a null doc_id comes last; rows with equal ids stay apart, in text order; texts of any
length are encoded whole; an empty table gives no rows; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import gc
import io
import json
import os
import re
import uuid
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, scratch, settle
from .text import slices

MAGIC = b"PSM8\x01\0\0\0"
BLOCK = 1024
#: How many ids a word holds under each selector, and their bits.
HOLDS = [240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
BITS = [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
#: The bits that each id under 2**16 takes.
WIDTH = np.array([next(b for b in BITS if x >> b == 0) for x in range(1 << 16)], np.uint8)
ESCAPE = np.uint64(2**64 - 1)
U = np.uint64


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, block offsets and the places of escaped words."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.empty(0, U), np.empty(0, U), np.empty(0, U)
    width = blocks * BLOCK
    pad = np.zeros(width + 256, U)
    pad[:n] = ids
    grid = np.zeros((blocks, BLOCK + 240), np.uint8)  # bits of each id; nothing looks past its block
    need = np.zeros(width, np.uint8)
    small = pad[:width] < U(1 << 16)
    if small.all():
        need = WIDTH[pad[:width].astype(np.uint16)]
    else:
        need[small] = WIDTH[pad[:width][small].astype(np.uint16)]
        rest = np.flatnonzero(~small)
        for b, more in ((16, 20), (20, 30), (30, 60)):
            need[rest[(pad[rest] >> U(b)) > 0]] = more
        need[rest[pad[rest] >= U(2**60 - 1)]] = 64
    grid[:, :BLOCK] = need.reshape(blocks, BLOCK)
    most = {1: grid}  # the most bits of so many ids from here on
    for k in (2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 120, 240):
        a = max(x for x in most if x <= k)
        b = max(x for x in most if x <= k - a) if k > a else None
        top = most[a].copy()
        while a < k:
            b = min(max(x for x in most if x <= k - a), k - a)
            np.maximum(top[:, : -a or None], most[b][:, a:], out=top[:, : -a or None])
            a += b
        most[k] = top
    pick = np.full((blocks, BLOCK), 15, np.uint8)
    for s in range(15):  # where a selector fits, so do all after it
        pick -= most[HOLDS[s]][:, :BLOCK] <= BITS[s]
    pick = pick.reshape(-1)
    holds = np.array(HOLDS)
    # All blocks step from word to word together.
    at, stop = np.arange(blocks) * BLOCK, np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    steps = []
    while len(at):
        steps.append(at)
        at = at + holds[pick[at]]
        live = at < stop
        at, stop = at[live], stop[live]
    start = np.sort(np.concatenate(steps))
    kind, escaped = pick[start], need[start] == 64
    words = kind.astype(U) << U(60)
    for s in range(2, 16):
        own = np.flatnonzero((kind == s) & ~escaped)
        if len(own):
            k = np.arange(HOLDS[s])
            inside = (start[own, None] % BLOCK + k) < BLOCK
            got = np.where(inside, pad[start[own, None] + k], U(0))
            words[own] |= np.bitwise_or.reduce(got << (k * BITS[s]).astype(U), axis=1)
    words[escaped] = ESCAPE
    out = np.insert(words, np.flatnonzero(escaped) + 1, pad[start[escaped]]) if escaped.any() else words
    moved = np.arange(len(words)) + np.cumsum(escaped) - escaped
    first = np.searchsorted(start, np.arange(blocks) * BLOCK)
    return out, moved[first].astype(U), moved[escaped].astype(U)


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ids: every word finds its place by a running sum from its block's offset, and each selector is spread at once."""
    out = np.zeros(n + 256, U)
    if not n:
        return out[:0]
    kind = (words >> U(60)).astype(np.int64)
    holds = np.array(HOLDS)[kind]
    escapes = escapes.astype(np.int64)
    holds[escapes], holds[escapes + 1] = 1, 0
    run = np.concatenate([[0], np.cumsum(holds)])
    offsets = offsets.astype(np.int64)
    block = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets, len(words))))
    place = block * BLOCK + run[:-1] - run[offsets][block]
    plain = np.ones(len(words), bool)
    plain[escapes] = plain[escapes + 1] = False
    for s in range(2, 16):
        own = np.flatnonzero((kind == s) & plain)
        if len(own):
            k = np.arange(HOLDS[s])
            to = place[own, None] + k
            got = (words[own, None] >> (k * BITS[s]).astype(U)) & U((1 << BITS[s]) - 1)
            inside = to < np.minimum((block[own] + 1) * BLOCK, n)[:, None]
            out[to[inside]] = got[inside]
    out[place[escapes]] = words[escapes + 1]
    return out[:n]


def segment(doc_ids: list, ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate([np.asarray(x).astype(U) for x in ids]) if ids else np.empty(0, U)
    words, offsets, escapes = pack(flat)
    head = np.array([len(doc_ids), len(flat), len(words), len(offsets), len(escapes)], "<u8")
    own = np.array([0 if x is None else x for x in doc_ids], "<i8")
    return b"".join([head.tobytes(), own.tobytes(), bytes(x is None for x in doc_ids), np.array([len(x) for x in ids], "<u8").tobytes(), offsets.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def read_segments(f) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_id, null flag, length and all ids of each segment of an open file."""
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of this format")
    take = lambda k, kind: np.frombuffer(f.read(k * np.dtype(kind).itemsize), kind)
    while len(head := f.read(40)):
        rows, n, n_words, blocks, n_escapes = map(int, np.frombuffer(head, "<u8"))
        doc_ids, null, size = take(rows, "<i8"), take(rows, "u1"), take(rows, "<u8")
        offsets, escapes, words = take(blocks, "<u8"), take(n_escapes, "<u8"), take(n_words, "<u8")
        yield doc_ids, null, size, unpack(words, offsets, escapes, n)


#: A chunk of one word of plain letters, and perhaps a run of marks: the vocabulary always breaks between them, and sees letters in lower case.
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]+)?")
#: The steps before the model under which that holds: composed, lower-cased, and cut into letters, digits and other runs.
STEPS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Library:
    """Ids by the tokenizers library.  White space parts words for good, so each distinct chunk is encoded once and kept."""

    def __init__(self, path: str, memo: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), memo
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[bytes, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        #: Which tokens end a word, where the vocabulary marks that.
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        #: The library's model behind steps that lower-case words of plain letters, parted by spaces, do without.
        self.plain = None
        own = json.loads(self.tokenizer.to_str())
        before, cut = ((own[k] or {}).get(x) or [] for k, x in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        if ([x["type"] for x in before], [x["type"] for x in cut]) == STEPS[:2] and cut[0]["pattern"].get("Regex", "").endswith(STEPS[2]) and self.ends.any():
            self.plain = Tokenizer.from_file(path)
            self.plain.no_truncation()
            self.plain.no_padding()
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def words(self, stems: list[str]) -> None:
        """Lower-case words go to the library many to a text, and their last tokens part them again."""
        for k in range(0, len(stems), 1 << 14):
            rows = [stems[i : i + 64] for i in range(k, min(k + (1 << 14), len(stems)), 64)]
            for r, e in zip(rows, self.plain.encode_batch_fast([" ".join(r) for r in rows], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                flat, at = ids.tobytes(), 0
                for t, b in zip(r, ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), strict=True):
                    self.memo[t.encode()] = flat[at:b]
                    at = b

    def whole(self, chunks: list[bytes]) -> None:
        for k in range(0, len(chunks), 4096):
            some = chunks[k : k + 4096]
            got = self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in some], add_special_tokens=False)
            self.memo.update((c, array("I", e.ids).tobytes()) for c, e in zip(some, got, strict=True))

    def learn(self, chunks: set[bytes]) -> None:
        """A word and the marks behind it are chunks of their own, which others share; what is no plain word goes to the library as it is."""
        memo, own, put = self.memo, [], []
        stems, marks = set(), set()
        for c in chunks:
            m = self.plain and PLAIN_WORD.fullmatch(c.decode("utf-8", "replace"))
            if m:
                stem, mark = m.groups()
                stem = stem.lower()
                put.append((c, stem, mark))
                stems.add(stem)
                if mark:
                    marks.add(mark.encode())
            else:
                own.append(c)
        self.words([t for t in stems if t.encode() not in memo])
        self.whole([*own, *(x for x in marks.difference(own) if x not in memo)])
        for c, stem, mark in put:
            memo[c] = memo[stem.encode()] + memo[mark.encode()] if mark else memo[stem.encode()]

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text.  Nothing here refers to itself, so the collector, which would go through all chunks again and again, waits."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self.encoded(texts)
        finally:
            if on:
                gc.enable()

    def encoded(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [t.split() for t in texts]
        own = set(chain.from_iterable(split))
        if len(self.memo) > self.most:  # keep what is in use
            self.memo = {c: self.memo[c] for c in own if c in self.memo}
        if new := own.difference(self.memo):
            self.learn(new)
        get = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(get, x)), "<u4") for x in split]


LOADED: dict[str, Library] = {}


def library(path: str) -> Callable[[list[bytes]], list[np.ndarray]]:
    if path not in LOADED:
        LOADED[path] = Library(path)
    return LOADED[path]


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, to: str, files: int | None = None, segment_bytes: int = 4 << 20) -> DataFrame:
    """Encode every text, append end_id, write the ids in ascending doc_id order, and return the manifest of files.

    Rows go to files by ranges of doc_id; each file is in order, and so are the files.  A task writes under a name of its own
    and the manifest, itself a table in the shared folder, lists only what successful tasks wrote, so a lost executor leaves
    at most an unlisted file.
    """
    spark = docs.sparkSession
    files = files or parts(spark)
    ordered = docs.select("doc_id", "text").repartitionByRange(files, F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, path, n_docs, n_ids, first = library(tokenizer), None, "", 0, 0, None
        for batch in batches:
            for b in slices(batch, "text", segment_bytes):
                own = b.column(0).to_pylist()
                ids = [np.append(x, np.uint32(end_id)) for x in encode([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()])]
                if out is None:
                    store, folder = fs.FileSystem.from_uri(to)
                    store.create_dir(folder, recursive=True)
                    path = f"{folder}/{uuid.uuid4().hex}.s8b"
                    out, first = store.open_output_stream(path), own[0]
                    out.write(MAGIC)
                out.write(segment(own, ids))
                n_docs, n_ids = n_docs + len(own), n_ids + sum(map(len, ids))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{to}/{path.rpartition('/')[2]}"], "first_id": pa.array([first], pa.int64()), "n_docs": [n_docs], "n_ids": [n_ids], "part": [partition()]})

    return settle(ordered.mapInArrow(run, "path string, first_id bigint, n_docs bigint, n_ids bigint, part bigint"), "manifest")


def partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start, ids (binary, little-endian uint32) of every row, read from the files alone.

    The manifest has a row a file, so the driver adds up where each file starts."""
    spark, start, rows = manifest.sparkSession, 0, []
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        rows.append((r["path"], start))
        start += r["n_ids"]
    at = spark.createDataFrame(rows, "path string, start bigint").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                store, where = fs.FileSystem.from_uri(path)
                with store.open_input_stream(where) as f:
                    for doc_ids, null, size, ids in read_segments(f):
                        ends = np.cumsum(size.astype(np.int64))
                        flat, begins = ids.astype("<u4"), ends - size.astype(np.int64)
                        out = [flat[a:b].tobytes() for a, b in zip(begins, ends, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=null.astype(bool)), pa.array(start + begins, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "start", "ids"])
                        start += len(ids)

    return at.mapInArrow(run, "doc_id bigint, start bigint, ids binary")


def digests(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the files, read them back, and describe each row from what was read."""
    manifest = write_ids(docs, tokenizer, end_id, scratch(docs.sparkSession, "ids"))
    return read_ids(manifest).select("doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def file_bytes(doc_ids: list, ids: list[np.ndarray]) -> io.BytesIO:
    """A whole file in memory."""
    return io.BytesIO(MAGIC + segment(doc_ids, ids))
