"""Substring dedup by content-defined chunking with a gear rolling hash.

A text is cut between words: runs of letters, digits and bytes above 0x7F, except Unicode white space, which sets
words apart, and code points of scripts written without spaces (from U+3000 on), which are a word each. The gear hash
of the last 16 bytes of a word decides: the text is cut after a word if its hash is the least among its neighbours on
either side, so chunks have four words at least and some seven on average, and a cut depends on nothing but the words
around it: after an insertion the cuts are the old ones again a few words later. Chunks are compared
by 128-bit digests of their bytes from the first word to the end of the last one. Runs of neighbouring chunks that stand
in other documents too, of MIN_WORDS words or more, are repeated passages. A repeated passage of 50 words keeps more than
that in whole chunks, while short shared lines stay below it.

Counting goes by digest with partial sums, so a chunk that a third of all documents share is summed
before the shuffle, and its places are joined back to the one row of its digest.

Defined results: null, empty and wordless texts have no chunk; a text of one chunk is one; a passage
that repeats inside one document only is none; rows of equal id are one document. A row with a null id is a
document of its own (equal texts one), before all ids; ids below -2^62 are taken for null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from namekit.llm import arrowtext
from namekit.llm.tables import arrow_map, written

REACH = 3
GEAR_BYTES = 16
MIN_WORDS = 20
SLICE_BYTES = 1 << 20
#: Documents without an id have numbers from here to _FIRST_ID.
_NO_ID = -(1 << 63)
_FIRST_ID = -(1 << 62)
#: One random 32-bit value for every byte.
GEAR = (arrowtext.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
#: White space beyond ASCII, as UTF-8: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """The rolling hash h = 2 h + GEAR[byte] over the last GEAR_BYTES bytes, after every byte: sums over
    1, 2, 4, ... bytes."""
    h = GEAR[raw]
    reach = 1
    while reach < GEAR_BYTES:
        h[reach:] += h[:-reach] << np.uint32(reach)  # the right side is a copy
        reach *= 2
    return h


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words of some texts."""
    n = len(raw)
    inside = arrowtext.IS_WORD[raw]
    for first in {w[0] for w in WIDE_SPACES}:
        at = np.flatnonzero(raw == first)
        for space in (w for w in WIDE_SPACES if w[0] == first):
            hit = at[at + len(space) <= n]
            for k in range(1, len(space)):
                hit = hit[raw[hit + k] == space[k]]
            for k in range(len(space)):
                inside[hit + k] = False
    begins = np.zeros(n + 1, bool)
    begins[:n] = inside
    begins[1:n] &= ~inside[:-1]
    begins[offsets] |= np.append(inside, False)[offsets]
    # a code point of three bytes from U+3000 on, or of four, is a word; so is what follows it
    for low, high, length in ((0xE3, 0xEE, 3), (0xEF, 0xF0, 3), (0xF0, 0x100, 4)):
        alone = np.flatnonzero((raw >= low) & (raw < high) & inside)
        begins[alone] = True
        after = np.minimum(alone + length, n)
        begins[after] |= np.append(inside, False)[after]
    start = np.flatnonzero(begins[:n])
    # a word ends where the next one begins, or its bytes do
    stop = np.flatnonzero(np.append(~inside, True))
    end = stop[np.searchsorted(stop, start)]
    following = np.append(start[1:], n)
    limit = offsets[np.searchsorted(offsets, start, "right")] if len(start) else following
    return start, np.minimum(np.minimum(end, following), limit)


def cuts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text, end of the last word, words) of the chunks of some texts. A chunk starts with its first word and
    ends where the next one starts."""
    start, end = words_of(raw, offsets)
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none, none, none, none
    # texts are set apart by GEAR_BYTES zeros, so that no hash reaches into the text before
    doc_length = np.diff(offsets)
    moved = np.zeros(len(raw) + GEAR_BYTES * len(doc_length), np.uint8)
    shift = np.repeat(np.arange(1, len(doc_length) + 1) * GEAR_BYTES, doc_length)
    moved[np.arange(len(raw)) + shift] = raw
    at = end - 1
    value = gear_hashes(moved)[at + shift[at]].astype(np.int64)
    doc = np.searchsorted(offsets, start, "right") - 1
    inner = np.flatnonzero(doc[1:] == doc[:-1])  # words with another one after them
    value, of = value[inner], doc[inner]
    least = np.ones(len(inner), bool)
    for k in range(1, REACH + 1):
        if len(inner) > k:
            same = of[k:] == of[:-k]
            least[k:] &= ~same | (value[k:] < value[:-k])   # of equal hashes the first
            least[:-k] &= ~same | (value[:-k] <= value[k:])
    first = np.zeros(len(start), bool)
    first[0] = True
    first[1:] = doc[1:] != doc[:-1]
    first[inner[least] + 1] = True
    head = np.flatnonzero(first)
    last = np.append(head[1:], len(start)) - 1
    stop = np.append(start[head[1:]], len(raw))
    return start[head], np.minimum(stop, offsets[doc[head] + 1]), doc[head], end[last], last - head + 1


def chunk_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d1, d2: digest, doc, place: number in its text, first, last: byte range, words) of all chunks."""
    text = F.col(text_col).cast("string")
    own = F.lit(_NO_ID) + F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), own).alias("doc"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = arrowtext.text_array(batch.column(1))
            ids = batch.column(0).to_numpy()
            for a, b in arrowtext.slices(texts, SLICE_BYTES):
                raw, offsets = arrowtext.buffers(texts.slice(a, b - a))
                if not len(raw):
                    continue
                start, end, doc, close, words = cuts(raw, offsets)
                data = raw.tobytes()
                digest = np.frombuffer(b"".join(
                    [hashlib.blake2b(data[x:y], digest_size=16).digest() for x, y in zip(start.tolist(), close.tolist(), strict=True)]),
                    np.int64).reshape(-1, 2)
                first = np.searchsorted(doc, doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(ids[a:b][doc]),
                     pa.array((np.arange(len(doc)) - first).astype(np.int32)), pa.array(start - offsets[doc]), pa.array(end - offsets[doc]),
                     pa.array(words.astype(np.int32))],
                    names=["d1", "d2", "doc", "place", "first", "last", "words"])

    return arrow_map(rows, run, "d1 long, d2 long, doc long, place int, first long, last long, words int")


def _places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The chunks that stand in several documents, with the least id that has each."""
    chunks = written(chunk_rows(docs, id_col, text_col))
    repeated = written(chunks.groupBy("d1", "d2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
                       .where("least < most").select("d1", "d2", "least"))
    return chunks.join(repeated, ["d1", "d2"]).select("doc", "place", "first", "last", "words", "least")


def _runs(places: DataFrame, min_words: int) -> DataFrame:
    """Neighbouring chunks together, of ``min_words`` words or more."""
    # neighbours have the same difference of place and rank; equal ids may repeat a place
    rank = F.dense_rank().over(Window.partitionBy("doc").orderBy("place"))
    return (places.withColumn("run", F.col("place") - rank).groupBy("doc", "run", "place")
            .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("words").alias("words"), F.min("least").alias("least"))
            .groupBy("doc", "run")
            .agg(F.min("first").alias("start"), F.max("last").alias("end"), F.sum("words").alias("n_words"),
                 F.count("*").alias("n_chunks"), F.min("least").alias("least"))
            .where(F.col("n_words") >= min_words)
            .select(F.when(F.col("doc") >= _FIRST_ID, F.col("doc")).alias("doc_id"), "start", "end", "n_words", "n_chunks",
                    F.when(F.col("least") >= _FIRST_ID, F.col("least")).alias("first_doc_id"),
                    (F.col("least") < F.col("doc")).alias("redundant")))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end (bytes), n_words, n_chunks of every passage that stands in other documents
    too; first_doc_id: the least id that holds a chunk of it; redundant: whether that is another one."""
    return _runs(_places(docs, id_col, text_col), min_words)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id and text of every row, without the passages whose every chunk stands in a document of a
    smaller id. Rows with a null id, or with an id that repeats, keep their text."""
    drop = (_runs(_places(docs, id_col, text_col).where("least < doc"), min_words).where("doc_id is not null")
            .groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    repeats = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    marked = rows.join(drop.join(repeats, "doc_id", "left_anti"), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if spans:
                    data, kept, done = text.encode(), [], 0
                    for s in spans:
                        kept.append(data[done:s["start"]])
                        done = s["end"]
                    text = b"".join([*kept, data[done:]]).decode()
                new.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["doc_id", "text"])

    return arrow_map(marked.select("doc_id", "text", "spans"), run, "doc_id long, text string")
