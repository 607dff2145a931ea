"""Words of whole Arrow string columns as one Arrow array of bytes, exact and without a Python loop."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from namekit.llm import arrowtext

_CODES = np.arange(256)
#: Letters a-z, A-Z and bytes above 0x7F, for ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``.
IS_LETTER = ((_CODES >= 65) & (_CODES <= 90)) | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)


def word_array(texts: pa.Array, is_word: np.ndarray = arrowtext.IS_WORD) -> tuple[pa.Array, np.ndarray]:
    """All maximal runs of bytes in ``is_word``, A-Z lower-cased, as a large_binary array, and the
    index of each text's first word in it (and the total)."""
    raw, offsets = arrowtext.buffers(texts)
    low = arrowtext.LOWER[raw]
    n = len(low)
    inside = np.zeros(n + 1, bool)
    inside[:n] = is_word[low]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | begins))
    ends = np.flatnonzero(before & (~inside | begins))
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=places[1:])
    data = low[inside[:n]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data)])
    return words, np.searchsorted(starts, offsets)
