"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each task gathers the distinct pre-tokens that are new to it and encodes them all together: an
inverted index leads from the rank of a token pair to the positions where the pair stands, merges
are applied in rank order to all their positions at once, and only the neighbours of a merged pair
are looked up again. The ids of a pre-token are then reused wherever it occurs. The result equals a
word-by-word encoder's: if a merge makes a pair of the same or a lower rank, that pair goes first.

Texts are cut at the first white space after other characters, where no match of the pattern can
reach across, so a piece's ids do not depend on its surroundings; other texts are matched whole.

Defined results: a null or empty text has no tokens and decodes to nothing; special tokens are never
made; equal rows give equal rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namekit.llm import arrowtext
from namekit.llm.tables import arrow_map

#: Pieces kept with their ids between batches (twice as many at times), and the longest, in characters.
MEMO_PIECES = 220_000
MEMO_CHARS = 48

_SPACE_AFTER_SPACE = re.compile(r"[^\S ] |\s[^\S ]* ")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class MergeReplay:
    """Encodes many byte strings together. ``ranks``: token to rank, which is also its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = {i: t for t, i in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: by left id: right id to rank, of every way to split a token into two tokens
        none: dict[int, int] = {}
        self.pair = [none] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    if self.pair[left] is none:
                        self.pair[left] = {}
                    self.pair[left][right] = rank
        self.first = np.full((256, 256), -1, np.int64)
        for a in range(256):
            for b in range(256):
                self.first[a, b] = self.pair[self.byte[a]].get(int(self.byte[b]), -1)

    def encode(self, words: Iterable[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        words = list(words)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        if not n:
            return [b""] * len(words)
        # neighbours of each position, -1 beyond its word
        last = np.zeros(n, bool)
        last[ends[ends > 0] - 1] = True
        follows = np.where(last, -1, np.arange(1, n + 1))
        precedes = np.where(np.append(True, last[:-1]), -1, np.arange(-1, n - 1))
        ranks = np.full(n, -1, np.int64)
        ranks[:-1] = np.where(last[:-1], -1, self.first[raw[:-1], raw[1:]])
        # the inverted index: rank of a pair to its positions
        place = np.flatnonzero(ranks >= 0)
        place = place[np.argsort(ranks[place], kind="stable")]
        known, at = np.unique(ranks[place], return_index=True)
        index = dict(zip(known.tolist(), (x.tolist() for x in np.split(place, at[1:])), strict=False))
        ids, after, before, rank = self.byte[raw].tolist(), follows.tolist(), precedes.tolist(), ranks.tolist()
        pair = self.pair
        queue = list(index)
        while queue:
            r = heapq.heappop(queue)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            right_of = pair[r]
            for k, p in enumerate(places):
                if rank[p] != r:
                    continue
                q = after[p]
                nxt = after[q]
                ids[p], after[p], rank[q] = r, nxt, -2
                new = -1
                least = r + 1
                if nxt >= 0:
                    before[nxt] = p
                    new = right_of.get(ids[nxt], -1)
                    if new >= 0:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heapq.heappush(queue, new)
                        least = new
                rank[p] = new
                o = before[p]
                if o >= 0:
                    rank[o] = new = pair[ids[o]].get(r, -1)
                    if new >= 0:
                        if new in index:
                            index[new].append(o)
                        else:
                            index[new] = [o]
                            heapq.heappush(queue, new)
                        if new < least:
                            least = new
                if least <= r:  # goes before the rest of this rank
                    rest = places[k + 1:]
                    if rest:
                        if r in index:
                            index[r].extend(rest)
                        else:
                            index[r] = rest
                            heapq.heappush(queue, r)
                    break
        stays = np.array(rank) != -2
        data = np.array(ids, "<u4")[stays].tobytes()
        cut = np.concatenate([[0], 4 * np.cumsum(stays)[ends - 1] * (ends > 0)]).tolist()
        return [data[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]


class Codec:
    """Text to ids and back, with the ids of frequent pieces at hand."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay = MergeReplay(ranks)
        self.pattern = regex.compile(pattern)
        #: ids of pieces and of pre-tokens; what was not used since the last change of generation goes
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Cuts of ``text`` whose tokens do not depend on each other."""
        parts = text.split(" ")
        if len(parts) == 1:
            return parts
        if "" in parts or _SPACE_AFTER_SPACE.search(text):
            return self.pattern.findall(text)
        return [parts[0], *[" " + x for x in parts[1:]]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.memo) > MEMO_PIECES:
            self.memo, self.older = {}, self.memo
        if len(self.words) > MEMO_PIECES:
            self.words, self.older_words = {}, self.words
        memo, known = self.memo, self.words
        cut = [self.pieces(t) for t in texts]
        new = set().union(*cut) - memo.keys()
        for p in new & self.older.keys():
            memo[p] = self.older[p]
        new -= memo.keys()
        words = {p: self.pattern.findall(p) for p in new}
        unknown = set().union(*words.values()) - known.keys()
        for w in unknown & self.older_words.keys():
            known[w] = self.older_words[w]
        unknown = list(unknown - known.keys())
        known.update(zip(unknown, self.replay.encode(w.encode() for w in unknown), strict=True))
        get = known.__getitem__
        for p, ws in words.items():
            memo[p] = b"".join(map(get, ws))
        get = memo.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in cut]
        for store, added in ((memo, words), (known, unknown)):
            for p in [p for p in added if len(p) > MEMO_CHARS]:
                del store[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[int, str], Codec] = {}


def _codec(key: str, ranks, pattern: str) -> Codec:
    """This worker's codec; it outlives a task."""
    if (key, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[key, pattern] = Codec(ranks.value, pattern)
    return _CODECS[key, pattern]


def share_ranks(spark: SparkSession, path: str):
    """The vocabulary for all executors (a fixed file of some 50,000 tokens, read by the driver)."""
    ranks = read_ranks(path)
    key = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return key, spark.sparkContext.broadcast(ranks)


#: Bytes of text encoded together.
SLICE_BYTES = 2 << 20


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array of int, if ``with_ids``), ids_sha256 of the ids as little-endian
    32-bit integers, decoded_sha256 of the bytes that the ids decode to, round_trip (whether these
    are the text's own)."""
    key, ranks = share_ranks(docs.sparkSession, path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, ranks, pattern)
        for batch in batches:
            texts = arrowtext.text_array(batch.column(1))
            for a, b in arrowtext.slices(texts, SLICE_BYTES):
                text = texts.slice(a, b - a).to_pylist()
                ids = codec.encode(text)
                back = [codec.decode(x) for x in ids]
                columns = {
                    "doc_id": batch.column(0).slice(a, b - a),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                    "round_trip": pa.array([x == t.encode() for x, t in zip(back, text, strict=True)], pa.bool_()),
                }
                if with_ids:
                    columns["ids"] = pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return arrow_map(rows, run, schema + ", ids array<int>" * with_ids)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows with an ``ids`` array; null ids give a null text, an id outside the
    vocabulary or bytes that are no UTF-8 the replacement character."""
    ranks = share_ranks(encoded.sparkSession, path)[1]
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {i: t for t, i in ranks.value.items()}
        for batch in batches:
            texts = [None if ids is None else b"".join(token.get(i, b"\xef\xbf\xbd") for i in ids).decode(errors="replace")
                     for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return arrow_map(rows, run, "doc_id long, text string")
