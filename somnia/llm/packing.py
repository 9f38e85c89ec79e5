"""Packing of tokenised documents into sequences of a fixed length: bounded-space online best fit."""

from __future__ import annotations

import base64
import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written

#: Unbroken runs that the byte-pair merge of one library would take quadratic time for.
LONG_RUN = re.compile(r"\S{2000}|\s{2000}")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.lru_cache(maxsize=2)
def _encoders(name: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    reference = Tokenizer.from_file(public_tokenizers.path(name))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb"))}
    special = [t.content for t in reference.get_added_tokens_decoder().values()]
    return reference, tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), special


def encode(text: str, name: str = "byte_bpe_50k.json") -> np.ndarray:
    """Ids of one text, as the ``tokenizers`` file gives them without added specials.

    The same vocabulary as ranks is four times as fast and gives the same ids; texts which name a special token or hold
    runs of 2,000 characters without a break go to ``tokenizers`` itself.
    """
    reference, ranks, special = _encoders(name)
    if any(s in text for s in special) or LONG_RUN.search(text):
        return np.array(reference.encode(text, add_special_tokens=False).ids, "<u4")
    return np.array(ranks.encode_ordinary(text), "<u4")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end: int = 2,
           tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Token pieces of every document: (doc_id, piece, start, length, ids_crc32).

    A document is its ids and then ``end``; a NULL or empty text is ``end`` alone. Documents of at most ``size`` ids stay
    whole; of longer ones the first piece takes the remainder and all others are full. Repeated rows give repeated pieces,
    other columns are ignored, a NULL id stays NULL.
    """

    def cut(batches):
        for batch in batches:
            ids, out = batch.column("id").to_pylist(), []
            for doc, text in zip(ids, texts(batch), strict=True):
                tokens = np.append(encode(text.as_py(), tokenizer), np.uint32(end)).astype("<u4")
                first = len(tokens) % size or size
                edges = [0, *range(first, len(tokens) + 1, size)]
                out += [(doc, k, a, b - a, zlib.crc32(tokens[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                  ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


class OpenBins:
    """Open bins keyed by their free space: bit s of one integer says that a bin with s places free is open."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.bits, self.count = size, most, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.next = 0

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for ``length``: the open bin with the least free space that holds it, or a new one."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.count >= self.most:  # the fullest closes first
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, free = self.next, self.size
            self.next += 1
        if free > length:
            self.by_free[free - length].append(number)
            self.bits |= 1 << (free - length)
            self.count += 1
        return number, self.size - free

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.count -= 1
        return number


def pack(cut: DataFrame, size: int = 1024, open_bins: int = 512, pieces_per_task: int = 50_000) -> DataFrame:
    """Add (sequence_id, offset) to ``pieces``: an online best fit in each partition, with at most ``open_bins`` open.

    Pieces are dealt by a hash of the whole row, so copies spread and a retried task sees the same rows; a partition of
    about ``pieces_per_task`` loses at most its open bins at the end. A piece longer than ``size`` raises.
    """
    cut = written(cut)
    tasks = max(1, -(-cut.count() // pieces_per_task))
    order = ["doc_id", "piece", "start", "length", "ids_crc32"]
    dealt = cut.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(F.xxhash64("doc_id", "piece"), *order)

    def fill(batches):
        from pyspark import TaskContext
        base, bins = TaskContext.get().partitionId() << 33, OpenBins(size, open_bins)
        for batch in batches:
            lengths = batch.column("length")
            if len(batch) and pc.max(lengths).as_py() > size:
                raise ValueError(f"a piece is longer than {size}")
            placed = np.array([bins.place(n) for n in lengths.to_pylist()], np.int64).reshape(-1, 2)
            yield pa.record_batch([*batch.columns, pa.array(placed[:, 0] + base), pa.array(placed[:, 1])], [*batch.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(fill, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, size: int = 1024, open_bins: int = 512, **columns) -> DataFrame:
    """Cut and pack: one row per piece."""
    return pack(pieces(docs, size=size, **columns), size, open_bins)
