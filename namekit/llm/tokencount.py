"""Token counts of whole texts by overlap resynchronisation.

A huge text is encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at a
boundary that both encodings agree on: from there on both have the same tokens at the same places
up to the end of the first chunk's safe part, the same tokens stand before it, and white space
stands beside it. Where the overlap holds no such boundary, it is widened until one is found or the
two chunks are encoded as one. Counts are exact where the tokenizer's matches do not reach across
white space; ``count_tokens`` demands that the vocabulary file says so.

A text of one chunk needs no splice. Its tokens are counted by pieces between spaces and line
breaks, which are such boundaries by themselves, and the count of a frequent piece is reused.

Defined results: a null or empty text has no tokens and no bytes; equal rows give equal rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namekit.llm import arrowtext
from namekit.llm.tables import arrow_map

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
#: Tokens that must agree on either side of a splice.
AGREE = 8
#: Pieces kept with their counts between batches (twice as many at times), and the longest, in characters.
MEMO_PIECES = 250_000
MEMO_CHARS = 48
SLICE_BYTES = 2 << 20

_PIECE = re.compile(r"[ \n]+")


def load(config: str):
    """The tokenizer of a vocabulary file's text, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(config)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def drops_white_space(config: str) -> bool:
    """Whether the pre-tokenizer keeps only matches that cannot hold white space, and the normalizer
    treats a text's parts between white space alike wherever they stand."""
    c = json.loads(config)
    steps = (c.get("pre_tokenizer") or {}).get("pretokenizers") or [c.get("pre_tokenizer") or {}]
    splits = [s for s in steps if s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert")]
    norms = (c.get("normalizer") or {}).get("normalizers") or [c.get("normalizer") or {}]
    plain = all(n.get("type") in ("NFC", "Lowercase", None) or n.get("type") == "Replace" and n.get("content") == " "
                and n["pattern"].get("Regex") == r"\s+" for n in norms)
    own = all(not t.get("lstrip") and not t.get("rstrip") and not re.search(r"\s", t["content"])
              for t in c.get("added_tokens") or [])
    if not splits or not plain or not own:
        return False
    import regex

    # no branch of the first split's pattern matches white space, alone or after another character
    pattern = regex.compile(splits[0]["pattern"].get("Regex", " "))
    spaces = " \n\t\r\x0b\x0c\x85\xa0 　"
    return not any(regex.search(r"\s", m) for s in spaces for a in ("a", "1", ".", "'", "")
                   for b in ("a", "1", ".", "s", "") for m in pattern.findall(a + s + b))


class Counter:
    """Counts a tokenizer's tokens."""

    def __init__(self, tokenizer, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.tokenizer, self.chunk, self.overlap = tokenizer, chunk, overlap
        #: counts of pieces; what was not used since the last change of generation goes
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.widened = 0

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.memo) > MEMO_PIECES:
            self.memo, self.older = {}, self.memo
        cut = [_PIECE.split(t) if len(t) <= self.chunk else None for t in texts]
        memo = self.memo
        new = set().union(*[c for c in cut if c is not None]) - memo.keys()
        for p in new & self.older.keys():
            memo[p] = self.older[p]
        new = list(new - memo.keys())
        for i in range(0, len(new), 20_000):
            part = new[i:i + 20_000]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                memo[p] = len(e)
        get = memo.__getitem__
        out = [sum(map(get, c)) if c is not None else self.long(t) for c, t in zip(cut, texts, strict=True)]
        for p in [p for p in new if len(p) > MEMO_CHARS]:
            memo.pop(p)
        return out

    def tokens(self, text: str, a: int, b: int) -> list[tuple[int, int, int]]:
        """(start, end, id) of the tokens of text[a:b], places in the whole text."""
        e = self.tokenizer.encode(text[a:b], add_special_tokens=False)
        return [(s + a, t + a, i) for (s, t), i in zip(e.offsets, e.ids, strict=True)]

    def long(self, text: str) -> int:
        """Tokens of a text of several chunks."""
        n = len(text)
        # the open chunk is text[start:end]; its tokens before `done` are part of `total`
        start, end, done, total = 0, min(n, self.chunk), 0, 0
        left = self.tokens(text, start, end)
        while end < n:
            overlap, at = self.overlap, None
            while at is None and end - overlap > start:
                a, b = end - overlap, min(n, end + self.chunk)
                right = self.tokens(text, a, b)
                at = self.splice(text, left, right, a)
                overlap *= 2
                self.widened += at is None
            if at is None:  # the overlap is the whole open chunk: it grows instead, to twice its size
                end = min(n, 2 * end - start)
                left = self.tokens(text, start, end)
            else:
                total += at[0] - done
                left, start, end, done = right, a, b, at[1]
        return total + len(left) - done

    @staticmethod
    def splice(text: str, left: list, right: list, a: int) -> tuple[int, int] | None:
        """Token numbers (in left, in right) of the last common boundary beyond text[a], else None."""
        places = {t: j for j, t in enumerate(right)}
        i = len(left) - AGREE
        while i >= AGREE and left[i - AGREE][0] >= a:
            s = left[i][0]
            j = places.get(left[i], -1)
            if (j >= AGREE and left[i - 1][1] < s and text[s - 1] in " \n"
                    and left[i - AGREE:i + AGREE] == right[j - AGREE:j + AGREE]):
                return i, j
            i -= 1
        return None


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). ``path``: a tokenizers .json file,
    read by the driver and sent to the executors (a fixed vocabulary)."""
    with open(path, encoding="utf-8") as f:
        config = f.read()
    if not drops_white_space(config):
        raise ValueError("this tokenizer's matches may hold white space, so chunks cannot be spliced there")
    key = hashlib.sha256(config.encode()).hexdigest() + f"/{chunk}/{overlap}"
    shared = docs.sparkSession.sparkContext.broadcast(config)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(load(shared.value), chunk, overlap)
        counter = _COUNTERS[key]
        for batch in batches:
            texts = arrowtext.text_array(batch.column(1))
            for a, b in arrowtext.slices(texts, SLICE_BYTES):
                part = texts.slice(a, b - a)
                n = counter.counts(part.to_pylist())
                _, offsets = arrowtext.buffers(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(offsets[1:] - offsets[:-1], pa.int64()),
                     pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
