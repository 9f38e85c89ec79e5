"""Packing of tokenised documents by the sum-of-squares rule: the level array counts the open windows at each fill."""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: The word pattern of the vocabulary over lower-case text, for characters where Python's classes agree with it; the byte 2 parts stretches.
WORD = re.compile(r"\x02|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w\x02]|_)+")
#: Stretches with any other character or a special token go to the vocabulary's own library, as do those of 2,000 characters.
OTHER = re.compile(r"[^\x21-\x7e¡-¬®-±´-¸º»¿-įı-ſΑ-ΡΤ-Ωά-ώЀ-ҁҊ-ӿ–-…ぁ-ゖァ-ヺ一-鿿]|<\|(?:start|end)oftext\|>")
#: Stretches that an encoder remembers before it starts anew.
REMEMBER = 600_000
#: Bytes of text that are split at a time, if no single text is longer.
SLICE = 1 << 22
#: Ids in open windows of one task before these are closed.
OPEN_IDS = 1 << 22
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Ids of whole texts as ``tokenizers`` gives them from the vocabulary file, every stretch without white space merged once.

    No word crosses white space, so ids of stretches add up to those of the text. The end of a word is written as the byte
    1, which none of these stretches holds, and joined to the last letter first; so the merges become plain byte ranks.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        path = public_tokenizers.path(name)
        self.library = Tokenizer.from_file(path)
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printed)}
        ranks = {}
        with open(path, encoding="utf-8") as f:
            for token, number in json.load(f)["model"]["vocab"].items():
                if token not in special:
                    body = token.removesuffix("</w>")
                    ranks[bytes(letters[c] for c in body) + b"\x01" * (body != token)] = number
        self.merge = tiktoken.Encoding(name, pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.parting = ranks[b"\x02\x01"]
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(2, np.int64)

    def _learn(self, stretches: list[str]) -> None:
        new = [w for w in stretches if w not in self.number]
        if new and len(self.number) + len(new) > REMEMBER:
            self._forget()
            new = [w for w in stretches if w]
        other = [w for w in new if len(w) >= 2000 or OTHER.search(w)]
        if other:
            rare = set(other)
            new = [w for w in new if w not in rare]
        if new:
            ids = np.array(self.merge("\x01".join(WORD.findall("\x02".join(new).lower() + "\x02")) + "\x01"), "<u4")
            parted = ids == self.parting
            self._add(new, ids[~parted], np.cumsum(~parted)[parted])
        for w in other:
            ids = np.array(self.library.encode(w, add_special_tokens=False).ids, "<u4")
            self._add([w], ids, [len(ids)])

    def _add(self, stretches: list[str], ids: np.ndarray, ends) -> None:
        if len(ends) != len(stretches):
            raise ValueError("stretches and their ends differ")
        self.number.update(zip(stretches, range(len(self.number), len(self.number) + len(stretches))))
        self.ends = np.append(self.ends, np.asarray(ends, np.int64) + len(self.ids))
        self.ids = np.append(self.ids, ids)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of every text of a column without NULL."""
        split = pc.ascii_split_whitespace(column)
        words = split.flatten().dictionary_encode()
        stretches = words.dictionary.to_pylist()
        self._learn(stretches)
        at = np.fromiter(map(self.number.__getitem__, stretches), np.int64, len(stretches))[words.indices.to_numpy()]
        lengths = self.ends[at + 1] - self.ends[at]
        stops = np.append(0, np.cumsum(lengths))
        ids = self.ids[np.repeat(self.ends[at] - stops[:-1], lengths) + np.arange(stops[-1])]
        cuts = stops[np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=2)
def encoder(name: str) -> WordEncoder:
    """The encoder of a vocabulary file, one in each process."""
    return WordEncoder(name)


class LevelArray:
    """Open windows by fill: ``count[h]`` of them hold h ids, for 0 < h < size."""

    def __init__(self, size: int):
        self.size, self.held = size, 0
        self.count = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def choose(self, length: int) -> int:
        """The fill whose windows should take ``length`` ids, 0 for a new window.

        Moving a window from h to h + length changes the sum of squared counts by 2 (count[h + length] - count[h]) + 2; a
        full window no longer counts and a new one leaves no level. The least sum wins, of equals the fullest window.
        """
        if length == self.size:
            return 0
        change = 2 * (self.count[length:] - self.count[:self.size - length + 1]) + 2  # by level, from 0 to size - length
        change[-1] = 1 - 2 * self.count[self.size - length]
        change[0] = 2 * self.count[length] + 1
        allowed = self.count[:self.size - length + 1] > 0
        allowed[0] = True
        change[~allowed] = np.iinfo(np.int64).max
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def place(self, piece: tuple, length: int) -> list | None:
        """Put a piece where ``choose`` says; the pieces of a window that it fills are returned."""
        level = self.choose(length)
        window = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
            self.held -= level
        window.append(piece)
        level += length
        if level == self.size:
            return window
        self.count[level] += 1
        self.held += level
        self.open.setdefault(level, []).append(window)
        return None

    def close(self) -> Iterator[list]:
        """Windows without padding from those still open, which are empty afterwards.

        The fullest take their missing ids from the emptiest, whose pieces are cut for it. What one window is left with is
        cut into windows of powers of two.
        """
        left = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.held = {}, 0
        self.count[:] = 0
        first, spare = 0, []
        while first < len(left) or spare:
            window = left[first] if first < len(left) else []
            first += 1
            free = self.size - sum(b - a for _, a, b in window)
            while free and (spare or first < len(left)):
                spare = spare or left.pop()
                ids, a, b = spare.pop()
                taken = min(free, b - a)
                window.append((ids, a, a + taken))
                if taken < b - a:
                    spare.append((ids, a + taken, b))
                free -= taken
            if not free:
                yield window
                continue
            while window:  # the last one: its fill as powers of two, the largest first
                part, room = [], 1 << (sum(b - a for _, a, b in window).bit_length() - 1)
                while room:
                    ids, a, b = window.pop()
                    taken = min(room, b - a)
                    part.append((ids, a, a + taken))
                    if taken < b - a:
                        window.append((ids, a + taken, b))
                    room -= taken
                yield part


def pack_levels(docs: DataFrame, size: int = 2048, end: int = 1, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id",
                text_col: str = "text", open_ids: int = OPEN_IDS) -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then ``end``; a NULL or empty text is ``end`` alone. Each task packs the rows it reads as they
    come, so nothing is shuffled: full pieces of ``size`` ids are sequences of their own, the rest of a document goes to the
    level that leaves the least sum of squared counts. At the end of a task, or when its open windows hold ``open_ids`` ids,
    these are closed by cutting pieces, so that every sequence is full or a power of two long and none needs padding; a task
    adds fewer than log2(size) + 1 of the short ones each time. Sequences never span tasks, so a lost task is simply run
    again. Repeated rows are packed as rows of their own, other columns are ignored, a NULL id stays NULL.
    """

    def fill(batches):
        from pyspark import TaskContext
        sequence, levels = TaskContext.get().partitionId() << 33, LevelArray(size)
        encode = encoder(tokenizer).encode
        out: list[tuple] = []

        def emit(window):
            nonlocal sequence
            offset = 0
            for (doc, ids, base, total), a, b in window:
                out.append((doc, base + a, b - a, zlib.crc32(ids[a:b].tobytes()), total, sequence, offset))
                offset += b - a
            sequence += 1

        def rows():
            batch = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7,
                                    [c.split()[0] for c in SCHEMA.split(", ")])
            out.clear()
            return batch

        for batch in batches:
            ids, column, first = batch.column("id").to_pylist(), texts(batch), 0
            ends = np.cumsum(pc.binary_length(column).to_numpy())
            while first < len(column):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE, "right")))
                for doc, own in zip(ids[first:last], encode(column[first:last])):
                    own = np.append(own, np.uint32(end)).astype("<u4")
                    rest = len(own) % size
                    for a in range(0, len(own) - rest, size):
                        emit([((doc, own, 0, len(own)), a, a + size)])
                    if rest:
                        whole = (doc, own[len(own) - rest:].copy(), len(own) - rest, len(own))
                        if done := levels.place((whole, 0, rest), rest):
                            emit(done)
                    if levels.held > open_ids:
                        for window in levels.close():
                            emit(window)
                first = last
                yield rows()
        for window in levels.close():
            emit(window)
        yield rows()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(fill, SCHEMA)
