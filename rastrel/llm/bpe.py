"""Byte-level BPE by dynamic programming over byte prefixes.

A prefix's encoding has one last token, and it alone fixes the whole encoding: the token before
it ends the shorter prefix that it leaves. A token may follow another if and only if merging
their bytes would not cross between them, which is decided by undoing merges from the rank down.
Appending bytes adds entries; an edit keeps the entries of all bytes before it.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import regex

#: Distinct chunks whose ids a worker remembers before it starts afresh.
REMEMBERED = 500_000
#: Key of a token in a table by byte.
END = -1


class Vocabulary:
    """Token bytes with ranks as ids, each token's last merge, and the pairs that merge."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.longest = max(map(len, tokens), default=0)
        self.ids = {t: i for i, t in enumerate(tokens)}
        #: By token: its two halves, or itself twice where it is not a merge.
        self.halves: list[tuple[int, int]] = []
        self.merged: dict[tuple[int, int], int] = {}
        for i, t in enumerate(tokens):
            parts = self._merge_below(t, i) if len(t) > 1 else [i]
            if len(parts) == 2:
                self.halves.append((parts[0], parts[1]))
                self.merged[parts[0], parts[1]] = i
            else:
                self.halves.append((i, i))
        #: Tokens spelled backwards as nested tables by byte, with a token's id at END: walking down from a byte
        #: meets every token that ends there, shortest first.
        self.endings: dict = {}
        for i, t in enumerate(tokens):
            if len(t) == 1 or self.halves[i][0] != i:  # else merging never makes it
                node = self.endings
                for byte in reversed(t):
                    node = node.setdefault(byte, {})
                node[END] = i
        self._pairs: dict[tuple[int, int], bool] = {}

    def joined(self, left: int, right: int) -> bool:
        """may_follow, remembered."""
        found = self._pairs.get((left, right))
        if found is None:
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            found = self._pairs[left, right] = self.may_follow(left, right)
        return found

    def _merge_below(self, text: bytes, limit: int) -> list[int]:
        """Plain rank-order merging with the tokens of smaller rank only."""
        parts = [self.ids[text[k : k + 1]] for k in range(len(text))]
        while len(parts) > 1:
            ranks = [self.ids.get(self.tokens[a] + self.tokens[b], limit) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best >= limit:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [best]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is just these two tokens."""
        bound = len(self.tokens)  # merges of this rank and beyond come too late
        halves, merged = self.halves, self.merged
        while True:
            if merged.get((left, right), bound) < bound:
                return False
            if left > right:
                # The left token was made last: before, its right half stood here.
                inner = halves[left][1]
                if inner != left:
                    bound, left = left, inner
                    continue
                bound, inner = right + 1, halves[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                inner = halves[right][0]
                if inner != right:
                    bound, right = right + 1, inner
                    continue
                bound, inner = left, halves[left][1]
                if inner == left:
                    return True
                left = inner


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [found[k] for k in range(len(found))]


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


class PrefixEncoder:
    """The encoding of a growing or edited byte string: `last` holds each prefix's last token."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary, self.text, self.last = vocabulary, b"", []
        self.append(text)

    def _grow(self, text: bytes, tail: list[int], moved: int) -> int:
        """Entries of all prefixes of text longer than those that have one, O(1) for each byte; how many were made.

        tail: entries that stood behind an edit, those of prefixes longer than `moved`. Entries depend on those of at most the
        longest token's bytes before, so as soon as that many in a row are as in tail, all the rest is."""
        begin, last = len(self.last), self.last
        root, joined, longest = self.vocabulary.endings, self.vocabulary.joined, self.vocabulary.longest
        same = 0
        for end in range(begin + 1, len(text) + 1):
            node, start, found = root, end, []
            while start:
                node = node.get(text[start - 1])
                if node is None:
                    break
                start -= 1
                if END in node:
                    found.append((start, node[END]))
            for start, token in reversed(found):
                if not start or joined(last[start - 1], token):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end}")
            if end > moved and tail:
                same = same + 1 if tail[end - moved - 1] == token else 0
                if same >= longest:
                    last += tail[end - moved :]
                    return end - begin
        return len(text) - begin

    def append(self, more: bytes) -> None:
        """Extend the text."""
        self.text += more
        self._grow(self.text, [], len(self.text))

    def edit(self, at: int, removed: int, added: bytes) -> int:
        """Replace `removed` bytes at `at`; how many entries were made anew: entries of the bytes before stay, and those behind
        from where the encoding is as it was."""
        tail = self.last[at + removed :]
        self.text = self.text[:at] + added + self.text[at + removed :]
        del self.last[at:]
        return self._grow(self.text, tail, at + len(added))

    def ids(self) -> list[int]:
        out, end = [], len(self.text)
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.vocabulary.tokens[token])
        return out[::-1]


class Codec:
    """encode() and decode() for whole texts: each match of `pattern` is encoded by itself."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.vocabulary = Vocabulary(tokens)
        self.find = regex.compile(pattern).findall
        self.table = tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        #: Little-endian ids of pieces, and of " " + chunk; None for a chunk that a text must not be cut at.
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes | None] = {}

    def _learn(self, pieces: Iterable[str]) -> None:
        """Encode new pieces in byte order, so that each goes on from the prefix that it shares with the one before."""
        table = PrefixEncoder(self.vocabulary)
        for raw in sorted({p.encode() for p in pieces}):
            whole = self.vocabulary.ids.get(raw)
            if whole is None:
                shared = _common(table.text, raw)
                table.edit(shared, len(table.text) - shared, raw[shared:])
                ids = table.ids()
            else:
                ids = [whole]
            self.known[raw.decode()] = struct.pack(f"<{len(ids)}I", *ids)

    def _chunks(self, chunks: set[str]) -> None:
        """Remember new chunks. A chunk that is empty or has space at an end stands at a run of spaces."""
        cut = {c: None if not c or c[0].isspace() or c[-1].isspace() else self.find(" " + c) for c in chunks}
        self._learn({p for pieces in cut.values() if pieces for p in pieces if p not in self.known})
        for c, pieces in cut.items():
            self.spaced[c] = None if pieces is None else b"".join(map(self.known.__getitem__, pieces))

    def _pieces(self, text: str) -> bytes:
        pieces = self.find(text)
        self._learn({p for p in pieces if p not in self.known})
        return b"".join(map(self.known.__getitem__, pieces))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts.

        A single space between two other characters always starts a match of the pattern, so a text may be cut
        there and repeated chunks looked up; a text with other spaces is matched as a whole."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.spaced) > REMEMBERED:
            self.spaced.clear()
        split = [(t or "").split(" ") for t in texts]
        self._chunks({c for first, *rest in split for c in rest}.difference(self.spaced))
        out = []
        for text, (first, *rest) in zip(texts, split, strict=True):
            if not text:
                out.append(np.zeros(0, "<u4"))
                continue
            try:
                if rest and first[-1:].isspace():
                    raise TypeError
                packed = self._pieces(first) + b"".join(map(self.spaced.__getitem__, rest))
            except TypeError:  # None among the chunks
                packed = self._pieces(text)
            out.append(np.frombuffer(packed, "<u4"))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """A process's codec for a file of ranks."""
    return Codec(load_ranks(path), pattern)


def encode_documents(docs, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"):
    """(id, ids array<int>): the ids of every whole text, without special tokens.

    Null and empty texts have no ids, and very long ones are encoded whole; repeated rows come out as often as they come in;
    ids don't matter, further columns are ignored, and an empty table gives an empty result."""
    import pyarrow as pa

    from rastrel.llm._io import map_slices

    def kernel(batch: pa.RecordBatch) -> dict:
        own = codec(path, pattern)
        found = own.encode_batch(batch.column(text_col).to_pylist())
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = pa.array(np.concatenate(found).astype(np.int32))
        return {id_col: batch.column(id_col), "ids": pa.ListArray.from_arrays(pa.array(ends), flat)}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs.select(id_col, text_col), kernel, f"`{id_col}` {kind}, ids array<int>", text_col)


def decode_documents(encoded, path: str, pattern: str, id_col: str = "doc_id"):
    """(id, data binary): the bytes of the ids in `ids`; null ids decode to none."""
    import pyarrow as pa

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            data = [own.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(id_col), "data": pa.array(data, pa.binary())})

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, data binary")


def round_trip(docs, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"):
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of each whole text's ids and of their decoded bytes.

    The ids stay in the worker that made them, so that only digests leave it."""
    import hashlib

    import pyarrow as pa

    from rastrel.llm._io import map_slices

    def kernel(batch: pa.RecordBatch) -> dict:
        own = codec(path, pattern)
        names = decimal_names(len(own.table))
        counts, digests, back = [], [], []
        for ids in map(np.ndarray.tolist, own.encode_batch(batch.column(text_col).to_pylist())):
            counts.append(len(ids))
            digests.append(hashlib.sha256(b" ".join(map(names.__getitem__, ids))).hexdigest())
            back.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return {id_col: batch.column(id_col), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(back, pa.string())}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs.select(id_col, text_col), kernel, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", text_col)


@lru_cache(maxsize=2)
def decimal_names(n: int) -> list[bytes]:
    return [b"%d" % k for k in range(n)]
