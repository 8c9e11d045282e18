"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is split by a pattern; each piece is merged on its own. The pairs of a piece wait in buckets, one per merge rank, that
hold positions in a linked list of parts. A three-level bitmap over the ranks gives the smallest rank that waits by three
find-first-set steps; within a bucket the leftmost position of a piece comes first, and entries whose pair has changed
meanwhile are stale and skipped. A piece of n bytes takes O(n log n) whatever its length (``merge``).

Pieces are independent, so the short ones of many texts share one queue (``merge_all``): a bucket then holds positions of many
pieces, and one numpy step merges the leftmost of each. Pieces recur, so each worker keeps their ids, up to ``CACHE`` pieces
or ``HELD`` characters, and empties the table beyond that.

Texts within Latin-1 are split by the standard library's matcher under the same pattern with its classes written out, all
others by ``regex``; the pieces are the same.

Defined cases: null text is empty and has no ids; strings of special tokens are ordinary text; repeated rows each get the
same row; an empty table gives an empty result; other columns are ignored. Texts are encoded whole.
"""

import base64
import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

CACHE, HELD = 100_000, 4_000_000
#: Longest piece, in bytes, that shares a queue.
SHORT = 64
#: Characters of texts that are encoded together.
TOGETHER = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


#: The split pattern's classes within Latin-1, where the standard library's faster matcher can stand in.
LATIN_LETTER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
LATIN_NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
LATIN_SPACE = "\t-\r \u0085\u00a0"


def latin(pattern: str) -> str:
    """``pattern`` with its Unicode classes written out for Latin-1 texts."""
    for name, chars in ((r"\p{L}", LATIN_LETTER), (r"\p{N}", LATIN_NUMBER), (r"\s", LATIN_SPACE)):
        inside = re.compile(r"(\[\^?[^\]]*)" + re.escape(name))
        while inside.search(pattern):
            pattern = inside.sub(lambda m: m[1] + chars, pattern, count=1)
        pattern = pattern.replace(name, f"[{chars}]")
    return pattern.replace(r"\S", f"[^{LATIN_SPACE}]")


class Bitmap:
    """The ranks that wait: bits of ranks, 64 to a word; bits of non-zero words, 64 to a word; the third level is one integer."""

    def __init__(self, size: int) -> None:
        self.low, self.mid, self.top = [0] * (size // 64 + 1), [0] * (size // 4096 + 1), 0

    def add(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def first(self) -> int:
        """The smallest rank, by find-first-set on each level; -1 if none waits."""
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = (b << 6) + (word & -word).bit_length() - 1
        bits = self.low[a]
        return (a << 6) + (bits & -bits).bit_length() - 1

    def remove(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)


class Slots(dict):
    """Numbers of pieces; those that were new since ``fresh`` was emptied stand there."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.fresh.append(piece)
        return n


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Codec:
    """Ranks and pattern of a vocabulary, with encode and decode."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        spaced = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.split_any = regex.compile(spaced).findall
        self.split_latin = re.compile(latin(pattern)).findall
        self.size = size = max(ranks.values()) + 1
        bytes_of = [b""] * size
        for token, rank in ranks.items():
            bytes_of[rank] = token
        self.token_bytes = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.token_lengths = np.array([len(x) for x in bytes_of], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.byte_ids = np.array([ranks.get(bytes((b,)), size) for b in range(256)], np.int64)
        # Pairs of tokens that are a token together, as sorted numbers; the last one is beyond all.
        pairs = [(left * size + right, rank) for token, rank in ranks.items() for p in range(1, len(token))
                 if (left := ranks.get(token[:p])) is not None and (right := ranks.get(token[p:])) is not None]
        self.pairs, self.pair_ranks = np.array([*sorted(pairs), (size * size + size + 1, -1)], np.int64).T.copy()
        self.forget()

    def forget(self) -> None:
        """Empties the table of pieces."""
        self.slots, self.held = Slots(), 0
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return self.split_latin(text)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, -1 where they are none; the token ``size`` is in no pair."""
        number = left * self.size + right
        number[(left == self.size) | (right == self.size)] = -1
        at = np.searchsorted(self.pairs, number)
        return np.where(self.pairs[at] == number, self.pair_ranks[at], -1)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        waits, n = Bitmap(self.size), len(piece)
        buckets: dict[int, list[int]] = {}  # positions by rank, leftmost first
        end = list(range(1, n + 1))  # the part that starts at a position runs up to here
        before = list(range(-1, n))  # start of the part on its left
        waiting = [ranks.get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]  # the rank of the pair that starts here, or -1
        fresh = [(r, i) for i, r in enumerate(waiting) if r >= 0]
        while True:
            for rank, i in fresh:
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    waits.add(rank)
            rank = waits.first()
            if rank < 0:
                break
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                waits.remove(rank)
            fresh = []
            if waiting[i] != rank:
                continue  # stale
            j = end[i]
            end[i] = stop = end[j]
            waiting[i] = waiting[j] = -1
            if stop < n:
                before[stop] = i
                waiting[i] = r = ranks.get(piece[i : end[stop]], -1)
                if r >= 0:
                    fresh.append((r, i))
            k = before[i]
            if k >= 0:
                r = ranks.get(piece[k:stop], -1)
                if r != waiting[k]:
                    waiting[k] = r
                    if r >= 0:
                        fresh.append((r, k))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and how many each has, from one queue over all of them."""
        none, lengths = self.size, np.array([len(p) for p in pieces], np.int64)
        n = int(lengths.sum())
        piece = np.repeat(np.arange(len(pieces)), lengths)
        ends = np.cumsum(lengths)
        # Position n stands for the outside of every piece; its token is in no pair.
        token = np.full(n + 1, none, np.int64)
        token[:n] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before, alive = np.arange(1, n + 2), np.arange(-1, n), np.ones(n, bool)
        after[ends - 1] = n
        before[ends - lengths] = n
        waiting = np.full(n + 1, -1, np.int64)  # the rank of the pair that starts here, or -1
        waiting[:n] = self.rank_of(token[:n], token[after[:n]])
        waits, buckets = Bitmap(self.size), {}

        def push(rank: np.ndarray, at: np.ndarray) -> None:
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            begin = [0, *cut.tolist()]
            for r, x, y in zip(rank[begin].tolist(), begin, [*begin[1:], len(rank)]):
                if r in buckets:
                    buckets[r].append(at[x:y])
                else:
                    buckets[r] = [at[x:y]]
                    waits.add(r)

        at = np.flatnonzero(waiting >= 0)
        if len(at):
            push(waiting[at], at)
        while (rank := waits.first()) >= 0:
            parts = buckets.pop(rank)
            waits.remove(rank)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[waiting[at] == rank]  # the rest is stale
            if len(at) > 1:
                at.sort()
                leftmost = np.ones(len(at), bool)
                leftmost[1:] = piece[at[1:]] != piece[at[:-1]]
                if not leftmost.all():
                    buckets[rank] = [at[~leftmost]]
                    waits.add(rank)
                    at = at[leftmost]
            elif not len(at):
                continue
            right = after[at]
            beyond, left = after[right], before[at]
            token[at], after[at], before[beyond] = rank, beyond, at
            alive[right], waiting[right] = False, -1
            new = self.rank_of(np.concatenate((token[at], token[left])), np.concatenate((token[beyond], token[at])))
            place = np.concatenate((at, left))
            changed = waiting[place] != new
            changed[: len(at)] = True
            waiting[place] = new
            waiting[n] = -1
            found = changed & (new >= 0)
            if found.any():
                push(new[found], place[found])
        return token[:n][alive].astype(np.int32), np.bincount(piece[alive], minlength=len(pieces))

    def learn(self) -> None:
        """Merges the new pieces, all that are short in one queue."""
        ranks, raw = self.ranks, [p.encode("utf-8") for p in self.slots.fresh]
        self.held += sum(map(len, raw))
        self.slots.fresh = []
        found: list = [None] * len(raw)
        queue = []
        for i, p in enumerate(raw):
            whole = ranks.get(p)
            if whole is not None:
                found[i] = [whole]
            elif len(p) > SHORT:
                found[i] = self.merge(p)
            else:
                queue.append(i)
        lengths = np.array([len(x) if x is not None else 0 for x in found], np.int64)
        apart = np.fromiter((t for x in found if x is not None for t in x), np.int32)
        starts = np.cumsum(lengths) - lengths
        ids, n = self.merge_all([raw[i] for i in queue]) if queue else (apart[:0], lengths[:0])
        lengths[queue] = n
        starts[queue] = len(apart) + np.cumsum(n) - n
        self.starts = np.concatenate((self.starts, starts + len(self.flat)))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.flat = np.concatenate((self.flat, apart, ids))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and the offsets of each text (one more than texts)."""
        if len(self.slots) > CACHE or self.held > HELD:
            self.forget()
        codes, cuts, at = [], [0], 0
        for text in texts:
            pieces = self.split(text)
            at += len(pieces)
            cuts.append(at)
            codes.append(np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces)))
        if self.slots.fresh:
            self.learn()
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        lengths = self.lengths[code]
        offsets = np.concatenate(([0], np.cumsum(lengths)))[cuts]
        return gathered(self.flat, self.starts[code], lengths), offsets

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, one after the other, and the offsets of each text in them."""
        lengths = self.token_lengths[ids]
        return gathered(self.token_bytes, self.token_starts[ids], lengths), np.concatenate(([0], np.cumsum(lengths)))[offsets]

    def decode(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        return self.decode_all(ids, np.array([0, len(ids)]))[0].tobytes()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a vocabulary file, made once per worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col="doc_id", text_col="text", decoded: bool = False) -> DataFrame:
    """One row per input row: ``id, ids``; with ``decoded`` also the bytes that the ids give again, in the same pass."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "ids", "decoded"] if decoded else ["id", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            column, at = batch.column("text"), 0
            while at < len(column):
                start, texts, size = at, [], 0
                while at < len(column) and size < TOGETHER:
                    texts.append(column[at].as_py() or "")
                    size += len(texts[-1])
                    at += 1
                ids, offsets = own.encode_all(texts)
                out = [batch.column("id")[start:at], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]
                if decoded:
                    data, cuts = own.decode_all(ids, offsets)
                    out.append(pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)]))
                yield pa.RecordBatch.from_arrays(out, names)
        give_back()

    schema = f"id {docs.schema['id'].dataType.simpleString()}, ids array<int>" + ", decoded binary" * decoded
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col="ids", out_col="decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids as ``out_col``; null ids give null."""

    @F.pandas_udf("binary")
    def run(ids: pd.Series) -> pd.Series:
        own = codec(path, pattern)
        return ids.map(own.decode, na_action="ignore")

    return encoded.withColumn(out_col, run(F.col(ids_col)))
