"""Operator 6: token counts by overlap resynchronisation.

A text longer than a chunk is encoded in overlapping chunks.  The bytes of each token give offsets, and two neighbouring
chunks are spliced at a boundary inside their overlap that is proven stable: no piece of the vocabulary holds the two
letters beside it in a row, so no merge ever crosses it, whatever stands around.  Where an overlap has no such boundary, or
the chunks do not both break there, it is widened, at last to the rest of the text.  Working memory follows a chunk.

Cases: a null or empty text has no bytes and no tokens; texts of any length are counted whole; repeated rows give repeated
counts, also where ids tie; an empty table gives no rows; other columns, whatever their names, are neither read nor passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices

SPACE = "▁"


class Counter:
    """Counts tokens as sentencepiece gives them for a BPE model with byte fallback and the identity normaliser."""

    def __init__(self, path: str, chunk: int = 16_384, overlap: int = 256):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        if overlap < 2 or chunk < overlap:
            raise ValueError("the overlap needs two letters, and a chunk more")
        self.chunk, self.overlap = chunk, overlap
        ids = range(m.get_piece_size())
        pieces = [m.id_to_piece(i) for i in ids]
        #: Bytes of the escaped text that each token stands for.
        self.size = np.array([1 if m.is_byte(i) else len(p.encode()) for i, p in zip(ids, pieces, strict=True)])
        whole = [p for i, p in zip(ids, pieces, strict=True) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        self.joined = {p[k : k + 2] for p in whole for k in range(len(p) - 1)}
        #: A line feed is in no piece: put before a chunk, it keeps the dummy space away from its letters.
        if any("\n" in p for p in whole) or m.encode("\n", out_type=str)[-1] != "<0x0A>":
            raise ValueError(f"{path}: line feeds are joined to other letters")
        self.lead = len(m.encode("\n"))

    def ends(self, text: str, start: bool) -> np.ndarray:
        """Where each token of a chunk of escaped text ends, in bytes."""
        ids = self.model.encode(text[1:] if start else "\n" + text)
        return np.cumsum(self.size[np.array(ids if start else ids[self.lead :], np.int64)])

    def count_long(self, text: str) -> int:
        n, at, stop, total = len(text) + 1, 0, 0, 0
        text = SPACE + text.replace(" ", SPACE)
        begin = 0  # where this chunk's text starts; its tokens count from `at`
        while True:
            overlap = self.overlap
            while True:
                stop = min(n, begin + self.chunk + overlap)
                here = text[begin:stop]
                ends = self.ends(here, begin == 0)
                skipped = len(text[begin:at].encode())
                done = int(np.searchsorted(ends, skipped, "right"))  # tokens that end at or before `at`
                if stop == n:
                    return total + len(ends) - done
                splice = self.splice(text, begin, stop, overlap, ends)
                if splice is not None and splice[0] > at:
                    break
                overlap *= 2  # at last the chunk holds the rest of the text
            to, tokens = splice
            total += tokens - done
            at = to
            begin = max(begin + 1, at - overlap // 2)  # the next chunk holds both sides of the splice

    def splice(self, text: str, begin: int, stop: int, overlap: int, ends: np.ndarray) -> tuple[int, int] | None:
        """The last boundary of the overlap, but for its margin, that is stable and at which this chunk breaks; the tokens before it."""
        for t in range(stop - overlap // 4 - 1, stop - overlap, -1):
            if text[t - 1 : t + 1] not in self.joined:
                size = len(text[begin:t].encode())
                k = int(np.searchsorted(ends, size))
                if k < len(ends) and ends[k] == size:
                    # The next chunk has to break there too.
                    around = text[max(begin, t - overlap // 2) : stop]
                    other = self.ends(around, max(begin, t - overlap // 2) == 0)
                    own = len(text[max(begin, t - overlap // 2) : t].encode())
                    if (other == own).any():
                        return t, k + 1
        return None

    def __call__(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        short = [k for k, t in enumerate(texts) if len(t) <= self.chunk + self.overlap]
        for k in range(0, len(short), 256):
            some = short[k : k + 256]
            for i, ids in zip(some, self.model.encode([texts[i] for i in some], num_threads=1), strict=True):
                out[i] = len(ids)
        own = set(short)
        for i, t in enumerate(texts):
            if i not in own:
                out[i] = self.count_long(t)
        return out


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, chunk: int = 16_384, overlap: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens are over `limit`."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, chunk, overlap)
        for batch in batches:
            for b in slices(batch, text_col):
                texts = [t or "" for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counter(texts), pa.int64())], [id_col, "n_bytes", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
