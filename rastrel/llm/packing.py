"""Vector best-fit packing of token sequences.

A bin has three capacities: tokens, documents and attention cost (the sum of squared lengths).
Pieces are dealt to tasks by a hash, a task takes its own in descending length, and each goes
to the open bin that, among those where it fits under every capacity, leaves the least weighted
norm of what remains (or has the largest weighted dot-product with what the piece needs).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm._io import map_slices, materialise, own_name

#: Tokens of a sequence, and the id that ends a document.
TOKENS, END = 2048, 0
#: Pieces that a task packs: many enough that its last, half-empty bins don't count.
PIECES_A_TASK = 16_384
#: Distinct chunks whose ids a worker remembers before it starts afresh.
REMEMBERED = 800_000


class Capacity(NamedTuple):
    """Of one sequence. By default only tokens bind: each piece has one token at least, and no lengths
    that add up to `tokens` have squares that add up to more than its square."""

    tokens: int = TOKENS
    documents: int = TOKENS
    attention: int = TOKENS * TOKENS


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTokenizer:
    """A tokenizer whose pieces never span white space, so that each chunk between spaces is looked up.

    New chunks of letters below U+0250, with or without one full stop or comma, are lower-cased and go to the model
    at once: neither composing nor splitting changes them. All others take the tokenizer's whole way."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of a lower-case word of letters below U+0250."""
        found = self.known.get(word)
        if found is None:
            spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            found = self.known[word] = _packed([t.id for t in self.model.tokenize(spelled)])
        return found

    def _learn(self, new: list[str]) -> None:
        other = []
        for chunk in new:
            low = chunk.lower()
            word = low[:-1] if low[-1] in ".," else low
            if word.isalpha() and len(low) == len(chunk) and max(chunk) < "\u0250":
                self.known[chunk] = self._word(word) + (self.known[low[-1]] if word is not low else b"")
            else:
                other.append(chunk)
        for chunk, found in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.known[chunk] = _packed(found.ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each whole text."""
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        if not known:
            known[""] = b""
            self._learn([".", ","])
        self._learn([c for c in {c for chunks in split for c in chunks} if c not in known])
        return [b"".join(map(known.__getitem__, chunks)) for chunks in split]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS, end: int = END, with_ids: bool = False) -> DataFrame:
    """(id, piece int, start, length, ids_crc32 long[, ids binary]): every row's ids and the end id, cut
    every `tokens` only where they are more. A null text counts as empty, so each row has one piece at least."""
    tail = np.array([end], "<u4").tobytes()

    def kernel(batch: pa.RecordBatch) -> dict:
        packed = [x + tail for x in tokenizer(path).encode(batch.column(text_col).to_pylist())]
        row, piece, start, length, crc, ids = [], [], [], [], [], []
        for k, x in enumerate(packed):
            for p, a in enumerate(range(0, len(x), 4 * tokens)):
                part = x[a : a + 4 * tokens]
                row.append(k)
                piece.append(p)
                start.append(a // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                ids.append(part if with_ids else b"")
        out = {id_col: batch.column(id_col).take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32())}
        out |= {"start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
        return out | ({"ids": pa.array(ids, pa.binary())} if with_ids else {})

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return map_slices(docs.select(id_col, text_col), kernel, schema, text_col)


def best_fit(lengths: np.ndarray, capacity: Capacity, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; lengths must be in descending order. rule: "norm" or "dot"."""
    full = np.array(capacity, np.float64)
    scale = np.array(weights) / full**2
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    room, names, used = np.empty((64, 3)), np.empty(64, np.int64), np.empty(64, np.int64)
    live = made = 0
    for k in range(n):
        size = int(lengths[k])
        need = np.array((size, 1.0, float(size) * size))
        if (need > full).any():
            raise ValueError(f"a piece of {size} tokens exceeds a bin")
        fits = np.flatnonzero((room[:live] >= need).all(axis=1))
        if len(fits):
            if rule == "norm":
                left = room[fits] - need
                best = int(fits[np.argmin((left * left) @ scale)])
            else:
                best = int(fits[np.argmax(room[fits] @ (need * scale))])
        else:
            if live == len(names):
                room, names, used = np.concatenate([room, np.empty_like(room)]), np.concatenate([names, names]), np.concatenate([used, used])
            best, live = live, live + 1
            room[best], names[best], used[best] = full, made, 0
            made += 1
        bins[k], offsets[k] = names[best], used[best]
        used[best] += size
        room[best] -= need
        least = int(lengths[-1])
        if room[best, 0] < least or room[best, 1] < 1 or room[best, 2] < least * least:
            live -= 1  # nothing that is left fits
            room[best], names[best], used[best] = room[live], names[live], used[live]
    return bins, offsets


def pack(found: DataFrame, id_col: str = "doc_id", capacity: Capacity = Capacity(), rule: str = "norm", pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """found with sequence_id and offset long: every piece in one sequence, gapless from 0, within `capacity`.

    Pieces are dealt by a hash of their id and number, about `pieces_a_task` to a task, so no id, source or length
    gathers in one task. Rows of one id and piece that repeat are packed as often as they occur."""
    total = found.count()
    tasks = max(1, round(total / pieces_a_task))
    columns = found.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if got:
            whole = pa.Table.from_batches(got).combine_chunks()
            lengths = whole.column("length").to_numpy()
            bins, offsets = best_fit(lengths, capacity, rule=rule)
            base = TaskContext.get().partitionId() << 32
            whole = whole.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))
            yield from whole.to_batches()

    task = own_name("_task", columns)
    # A row's number is the same in every run of a task, as files are dealt to tasks by their names and sizes.
    dealt = found.withColumn(task, F.pmod(F.xxhash64(id_col, "piece", F.monotonically_increasing_id()), F.lit(tasks)).cast("int"))
    dealt = dealt.repartitionById(tasks, F.col(task)).drop(task).sortWithinPartitions(F.desc("length"), id_col, "piece")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return dealt.select(columns).mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: Capacity = Capacity(), rule: str = "norm", with_ids: bool = False) -> DataFrame:
    """Every whole text of docs, tokenized, cut and packed: the columns of pieces() with sequence_id and offset.

    Null texts are empty and take one token, the end id; very long ones are cut into as many pieces as they need. Rows that repeat are packed as often as they occur; ids,
    null ones too, are only carried along. Further columns are ignored. An empty table gives an empty result."""
    found = materialise(pieces(docs, path, id_col, text_col, capacity.tokens, with_ids=with_ids), "pieces")
    return pack(found, id_col, capacity, rule)
