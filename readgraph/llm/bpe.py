"""Byte-level BPE by dynamic programming over byte prefixes.

The BPE encoding of every prefix of a byte string ends in exactly one token. If the table
``last[i]`` holds that token for each prefix of length i, the encoding of the whole string is read
off backwards: ``last[n]``, then ``last[n - len(last[n])]``, and so on. A token t that ends at i is
the right one exactly when it may follow ``last[i - len(t)]``, that is, when no merge across their
border would have come before the merges inside them.

The table depends only on the bytes to its left, and on no more of them than the longest token has.
So bytes can be appended without touching what is there, and after an edit only the entries near it
are computed anew, until the new entries agree with the old ones.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, held

#: A worker keeps so many encoded pieces (distinct matches of the pattern) and words, and as many older ones.
CACHE_PIECES, CACHE_WORDS = 60_000, 250_000
CACHE_PAIRS = 250_000
NEVER, SHIFT = 1 << 62, 32


class BpeModel:
    """Merge tables of a rank file: bytes of each token, its two halves, and the pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab = {i: b for b, i in ranks.items()}
        self.pairs: dict[int, int] = {}  # by a << SHIFT | b
        #: Each token's halves; None for one that no merge makes.
        self.lefts: dict[int, int | None] = {}
        self.rights: dict[int, int | None] = {}
        self._ok: dict[int, bool] = {}  # may_follow by a << SHIFT | b
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        #: Tokens that no merge makes; they stand only for a whole piece.
        self.unmergeable: set[int] = set()
        for token, i in sorted(ranks.items(), key=lambda x: (len(x[0]) > 1, x[1])):
            self._add(token, i)
        self._ok.clear()
        #: Tokens by their bytes from the last to the first: a tree of (tokens that end as the way to here, the longest
        #: first, as (length, id); branches by the byte before). Its first two levels are one list, by the last two bytes.
        self.endings: list[tuple | None] = [None] * 65_536
        self._grow(sorted((token[::-1], i) for token, i in ranks.items() if len(token) > 1 and i not in self.unmergeable))
        self.longest = max(map(len, ranks))

    def _add(self, token: bytes, i: int) -> None:
        """Find the last merge that makes ``token``."""
        for cut in range(1, len(token)):
            a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if a is not None and b is not None and a in self.lefts and b in self.lefts and self.may_follow(a, b):
                self.pairs[a << SHIFT | b] = i
                self.lefts[i], self.rights[i] = a, b
                return
        self.lefts[i] = self.rights[i] = None
        if len(token) > 1:
            self.unmergeable.add(i)

    def _grow(self, turned: list[tuple[bytes, int]]) -> None:
        way: list[tuple] = []  # nodes from two bytes on
        before = b""
        for token, i in turned:  # in order, so that a token comes after its own beginnings
            same = next((k for k, (x, y) in enumerate(zip(before, token, strict=False)) if x != y), min(len(before), len(token)))
            del way[max(same - 1, 0) :]
            for depth in range(len(way) + 2, len(token) + 1):
                above = way[-1][0] if way else ()
                node = (((depth, i), *above) if depth == len(token) else above, {})
                if way:
                    way[-1][1][token[depth - 1]] = node
                else:
                    self.endings[token[1] << 8 | token[0]] = node
                way.append(node)
            before = token

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together are encoded as a, b.

        The tokens along a border are a, its right half, that one's right half and so on, and so for b to the left.
        Each lives until the merge that takes it in. A pair across the border that lives at the time of its own merge would be merged; of equal merges the left one is first.
        """
        found = self._ok.get(a << SHIFT | b)
        if found is None:
            get, lefts, rights = self.pairs.get, self.lefts, self.rights
            found, x, x_until = True, a, NEVER
            while found and x is not None:
                y, y_until = b, NEVER
                while y is not None:
                    merge = get(x << SHIFT | y)
                    if merge is not None and merge < x_until and merge <= y_until:
                        found = False
                        break
                    y, y_until = lefts[y], y
                x, x_until = rights[x], x
            if len(self._ok) >= CACHE_PAIRS:
                self._ok.clear()
            self._ok[a << SHIFT | b] = found
        return found

    def extend(self, data: bytes, last: list[int], upto: int | None = None) -> None:
        """Grow the table (``last[0]`` is -1) to ``upto`` bytes of ``data``."""
        endings, known, may_follow, ranks = self.endings, self._ok.get, self.may_follow, self.ranks
        for end in range(len(last), (len(data) if upto is None else upto) + 1):
            node = endings[data[end - 2] << 8 | data[end - 1]] if end > 1 else None
            if node is not None:
                k = end - 3
                while k >= 0 and (longer := node[1].get(data[k])) is not None:
                    node = longer
                    k -= 1
                for n, t in node[0]:
                    before = last[end - n]
                    if before >= 0:
                        fits = known(before << SHIFT | t)
                        if fits is None:
                            fits = may_follow(before, t)
                        if not fits:
                            continue
                    last.append(t)
                    break
                else:
                    last.append(ranks[data[end - 1 : end]])
            else:
                last.append(ranks[data[end - 1 : end]])

    def read_off(self, last: list[int]) -> list[int]:
        ids, end = [], len(last) - 1
        while end:
            ids.append(last[end])
            end -= len(self.vocab[last[end]])
        return ids[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        if not data:
            return []
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        last = [-1]
        self.extend(data, last)
        return self.read_off(last)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


class PieceTable:
    """The prefix table of one piece; takes appends and edits and stays exact."""

    def __init__(self, model: BpeModel, data: bytes = b""):
        self.model, self.data, self.last = model, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.model.extend(self.data, self.last)

    def replace(self, start: int, end: int, by: bytes) -> int:
        """Put ``by`` for bytes start to end; return how many entries were computed."""
        old, shift = self.last, len(by) - (end - start)
        self.data = self.data[:start] + by + self.data[end:]
        self.last = old[: start + 1]
        at, agree, computed = start, 0, 0
        while at < len(self.data):
            at += 1
            self.model.extend(self.data, self.last, at)
            computed += 1
            # entries count as agreed once their tokens lie in bytes after the edit, or the edit is behind
            same = at >= start + len(by) and self.last[at] == old[at - shift]
            agree = agree + 1 if same else 0
            if agree >= self.model.longest:
                self.last += old[at - shift + 1 :]
                break
        return computed

    def ids(self) -> list[int]:
        whole = self.model.ranks.get(self.data)
        return [whole] if whole is not None else self.model.read_off(self.last)


class TextEncoding:
    """Ids of a text by pieces. An edit encodes only pieces near it; the others keep theirs."""

    #: A match of the pattern depends on at most so many characters after its end ("'ll" is the longest alternative).
    REACH = 3

    def __init__(self, model: BpeModel, pattern: str, text: str = ""):
        self.model, self.pattern, self.text = model, regex.compile(pattern), text
        self.pieces: list[tuple[int, int, list[int]]] = []
        self._scan(0, [], 0, 0)

    def _scan(self, at: int, old: list[tuple[int, int, list[int]]], shift: int, settled: int) -> int:
        """Split from ``at``; stop where a split of ``old`` (moved by shift) begins at ``settled`` or later."""
        starts = {s + shift: k for k, (s, _, _) in enumerate(old)}
        fresh = 0
        for m in self.pattern.finditer(self.text, at):
            k = starts.get(m.start())
            if k is not None and m.start() >= settled:
                self.pieces += [(s + shift, e + shift, ids) for s, e, ids in old[k:]]
                return fresh
            self.pieces.append((m.start(), m.end(), self.model.encode_piece(m[0].encode())))
            fresh += 1
        return fresh

    def replace(self, start: int, end: int, by: str) -> int:
        """Put ``by`` for characters start to end; return how many pieces were encoded."""
        old, shift = self.pieces, len(by) - (end - start)
        self.text = self.text[:start] + by + self.text[end:]
        keep = 0
        while keep < len(old) and old[keep][1] + self.REACH < start:
            keep += 1
        self.pieces = old[:keep]
        return self._scan(old[keep - 1][1] if keep else 0, old[keep:], shift, start + len(by))

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        return list(chain.from_iterable(ids for _, _, ids in self.pieces))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class _Held(dict):
    """Values by string, made when asked for; those not asked for since ``most`` others came are forgotten."""

    def __init__(self, most: int):
        self.most, self.older = most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


class _Pieces(_Held):
    """Packed ids by piece."""

    def __init__(self, model: BpeModel):
        super().__init__(CACHE_PIECES)
        self.model = model

    def make(self, piece: str) -> bytes:
        ids = self.model.encode_piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)


class _Words(_Held):
    """Packed ids of a space and a word; empty for a word that isn't split from what follows by itself.

    A match of the pattern takes at most one space, as its first character, before anything but white
    space, and white space before such a space is matched up to it. So a text splits there into parts
    whose matches don't depend on each other. That is every space unless white space comes after it.
    """

    def __init__(self, pieces: _Pieces, find):
        super().__init__(CACHE_WORDS)
        self.pieces, self.find, self.space = pieces, find, regex.compile(r"\s").match

    def make(self, word: str) -> bytes:
        if not word or self.space(word):
            return b""
        found = self.find(" " + word)
        if len(found) == 1:  # held as a word, so not as a piece too
            return self.pieces.make(found[0])
        return b"".join(map(self.pieces.__getitem__, found))

    def matches(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def text(self, text: str) -> bytes:
        first, *words = text.split(" ")
        parts = list(map(self.__getitem__, words))
        return self.matches(text) if b"" in parts else self.matches(first) + b"".join(parts)


def _coder(ranks: dict[bytes, int], pattern: str) -> _Words:
    return _Words(_Pieces(BpeModel(ranks)), regex.compile(pattern).findall)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep_ids: bool = False, split_at_spaces: bool = True) -> DataFrame:
    """Encode and decode every whole text.

    Adds ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers) and
    ``decoded_sha256`` (of the decoded bytes) to the columns of ``docs`` other than ``text``; with
    ``keep_ids`` also ``ids``. A null or empty text has no ids. Each row is its own result: repeated
    rows and ties stay, an empty table gives an empty one, other columns pass through, and columns of
    those names are replaced. The rank file (about 50,000 entries, fixed by the vocabulary) goes to each
    worker once, as a broadcast. Texts are split at spaces before the pattern is applied (see ``_Words``);
    patterns in which a space can be elsewhere than first in a match or in white space need
    ``split_at_spaces=False``.
    """
    spark = docs.sparkSession
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    schema = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string" + ", ids: array<bigint>" * keep_ids + ">"
    types = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int64())] * keep_ids
    shared, call = spark.sparkContext.broadcast((ranks, pattern)), uuid.uuid4().hex

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = held(call, lambda: _coder(*shared.value))
        vocab = words.pieces.model.vocab.__getitem__
        for batch in batches:
            columns = [[] for _ in types]
            for value in batch:  # one text at a time becomes a string
                text = value.as_py()
                packed = words.text(text) if split_at_spaces else words.matches(text)
                ids = np.frombuffer(packed, "<u4").tolist()
                row = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(b"".join(map(vocab, ids))).hexdigest(), ids)
                for column, found in zip(columns, row, strict=False):
                    column.append(found)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], added)

    coded = F.arrow_udf(run, schema)
    numbered, named = carried(docs, text.lower(), *added)
    return docs.select(*numbered, coded(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("coded")).select(*named, "coded.*")
