"""Near-duplicate documents by ProbMinHash, banding and verification.

A text's weighted set has its shingles of five lower-cased words with their numbers of occurrences.
Every shingle sends arrivals of a Poisson process, of its weight as rate, to random registers; a
register keeps its earliest arrival's shingle, and a text stops as soon as no arrival can be earlier
than its latest register. Two texts agree in a register with the probability Jaccard similarity
of their weighted sets. A text in which a shingle repeats has a second signature, of the same shingles with
weight 1, whose registers agree with the probability plain Jaccard; without repeats the two are one.
Texts that agree in a whole band of registers of either signature become candidates.

Equal word sequences are one node from the start, whatever their number. In a bucket of a band
all nodes meet one hub, so candidates grow with the rows and not with the square of a group. Every node
is tried with the hub that it shares most buckets with. The buckets that still hold several classes are then compared
in full by longer signatures, inside the task that holds a bucket, which
puts out no more candidates than it needs to connect the texts that agree. These candidates
make groups; one task takes the whole texts of a group once, verifies every agreeing pair whose
classes are not yet one, and puts out only the links that join classes. So what leaves a task grows with its
nodes, however many pairs of a family are close.

Buckets too large for one task are compared in full as well, block by block: every two blocks meet in a task. So the
classes do not depend on a bucket's size or on the size of a block.
Candidates whose registers agree too rarely by both signatures (over four standard errors below the threshold) go, the
others are verified on their whole texts: probability Jaccard or plain Jaccard of 0.8 or more. Classes
are the connected components of the verified links.

Defined results: texts without words (null ones as well) are alone in their classes; texts of one to
four words have one shingle of all of them; rows of equal text are in one class; a class's id is its
least doc_id (null if all are null).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namekit.llm import arrowtext
from namekit.llm.tables import arrow_map, written
from namekit.session import checkpoint_dir

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: A bucket of so many nodes at most is compared by one task; larger ones are dealt into blocks of so many.
FULL_NODES = 4_096
#: Texts that candidates connect are decided by one task if there are at most so many, of so many bytes; more are
#: dealt into blocks, of which every two meet in a task.
GROUP_NODES, GROUP_BYTES = 2_048, 32 << 20
#: Registers, of 8 bits, of the signatures for full comparison, and the share that must be equal.
LONG = 1_024
LEAST_LONG = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / LONG) ** 0.5
#: The first registers, that are looked at first, and their least share.
HEAD = 256
LEAST_HEAD = THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / HEAD) ** 0.5
#: Least share of equal registers for verification: the threshold less four standard errors.
LEAST_AGREED = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5
SLICE_BYTES = 1 << 20
SLICE_TEXTS = 1_024
#: Rows of (node, id, hash) that may be broadcast to fetch texts; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000

_GOLDEN = 0x9E3779B97F4A7C15
_STEP = np.uint64(_GOLDEN)
_NO_ID = -(1 << 63)


def shingles(words: arrowtext.Words, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of all texts, and the index of each text's first one."""
    h, first, counts = words.hashes, words.first, words.counts()
    n_each = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(n_each)])
    doc = np.repeat(np.arange(len(counts)), n_each)
    at = np.arange(start[-1]) - start[doc] + first[doc]
    length = np.minimum(counts[doc], size)
    out = length.astype(np.uint64)
    for k in range(size):
        have = k < length
        word = h[np.minimum(at + k, len(h) - 1)] if len(h) else h
        out = np.where(have, arrowtext.mix(out * _STEP + word), out)
    return out, start


def weighted(words: arrowtext.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of the distinct shingles of each text; 47 bits of a shingle's hash
    and up to 2^17 texts."""
    hashes, start = shingles(words)
    doc = np.repeat(np.arange(len(start) - 1, dtype=np.uint64), np.diff(start))
    key = np.sort(doc << np.uint64(47) | hashes >> np.uint64(17))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> np.uint64(47)).astype(np.int64), key & np.uint64((1 << 47) - 1), weight


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """The registers of ``n`` texts: 16 bits of the element that arrives first in each."""
    if registers > 2048:
        raise ValueError("a register is chosen by 11 bits")
    first = np.full(n * registers, np.inf)
    who = np.zeros(n * registers, np.uint64)
    element = arrowtext.mix(element + np.uint64(1))
    time = np.zeros(len(element))
    turn = 0
    while len(element):
        turn += 1
        draw = arrowtext.mix(element + np.uint64(turn * _GOLDEN % (1 << 64)))
        time = time - np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54) / weight
        at = doc * registers + ((draw & np.uint64(0x7FF)) * np.uint64(registers) >> np.uint64(11)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = time == first[at]
        who[at[won]] = element[won]
        # a text is done with an element whose next arrival is later than all its registers
        latest = first.reshape(n, registers).max(axis=1)
        on = time < latest[doc]
        if not on.all():
            doc, element, weight, time = doc[on], element[on], weight[on], time[on]
    return (arrowtext.mix(who) >> np.uint64(48)).astype(np.uint16).reshape(n, registers)


def both_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signatures of ``n`` texts, of those that repeat a shingle with weights 1, and the numbers of these."""
    repeats = np.zeros(n, bool)
    repeats[doc[weight > 1]] = True
    some = np.flatnonzero(repeats)
    mine = repeats[doc]
    at = np.cumsum(repeats) - 1
    ones = np.ones(int(mine.sum()), weight.dtype)
    return signatures(doc, element, weight, n, registers), signatures(at[doc[mine]], element[mine], ones, len(some), registers), some


def _binary(sig: np.ndarray, plain: np.ndarray, some: np.ndarray) -> list[pa.Array]:
    """Columns of the signatures; the second is null where it equals the first."""
    second: list = [None] * len(sig)
    for k, row in zip(some.tolist(), plain, strict=True):
        second[k] = row.tobytes()
    return [pa.array([row.tobytes() for row in sig], pa.binary()), pa.array(second, pa.binary())]


def _plain(first: pa.Array, second: pa.Array) -> pa.Array:
    """The signatures with weights 1."""
    return pc.coalesce(second, first)


def _digests(words: arrowtext.Words) -> list[bytes]:
    """128 bits of each text's word sequence."""
    n = len(words.low)
    keep = np.zeros(n + 1, np.int64)
    keep[words.starts] += 1
    np.subtract.at(keep, words.ends, 1)
    inside = np.cumsum(keep)[:n] > 0
    out = []
    low = np.where(inside, words.low, 32).astype(np.uint8)
    for d in range(len(words.offsets) - 1):
        a, b = words.offsets[d], words.offsets[d + 1]
        out.append(hashlib.blake2b(b" ".join(low[a:b].tobytes().split()), digest_size=16).digest())
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, id_key, text_key (64-bit hash of the text), n_words, d1, d2 (digest of the
    words) and the signatures, ``sig`` and ``plain`` (null where no shingle repeats)."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = arrowtext.text_array(batch.column(2))
            for x, y in arrowtext.slices(texts, SLICE_BYTES):
                for a in range(x, y, SLICE_TEXTS):
                    b = min(y, a + SLICE_TEXTS)
                    words = arrowtext.split(texts.slice(a, b - a))
                    sigs = _binary(*both_signatures(*weighted(words), b - a))
                    digest = np.frombuffer(b"".join(_digests(words)), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(words.counts(), pa.int64()),
                         pa.array(digest[:, 0]), pa.array(digest[:, 1]), *sigs],
                        names=["doc_id", "text_key", "n_words", "d1", "d2", "sig", "plain"])

    out = arrow_map(rows, run, "doc_id long, text_key long, n_words long, d1 long, d2 long, sig binary, plain binary")
    return out.withColumn("id_key", F.coalesce("doc_id", F.lit(_NO_ID)))


def _bands(sigs: pa.Array) -> np.ndarray:
    """The key of each band of some signatures."""
    sig = np.frombuffer(b"".join(sigs.to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sig.shape[:2])
    for r in range(ROWS):
        key = arrowtext.mix(key * _STEP + sig[:, :, r])
    return key


def _band_keys(nodes: DataFrame) -> DataFrame:
    """(node, key, age) for every band. Keys of the second signature (``plain``) follow where they differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, age = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            keys = [_bands(batch.column(1)), _bands(_plain(batch.column(1), batch.column(3)))]
            same = keys[0] == keys[1]
            for second, new in ((False, np.ones(same.shape, bool)), (True, ~same)):
                row, _ = np.nonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(node[row]), pa.array(keys[second][new].view(np.int64)), pa.array(age[row])],
                                                 names=["node", "key", "age"])

    return arrow_map(nodes.select("node", "sig", "id_key", "plain"), run, "node long, key long, age long")


def _longer(texts: DataFrame) -> DataFrame:
    """(node, long, long_plain): signatures of LONG registers of 8 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = arrowtext.text_array(batch.column(1))
            for x, y in arrowtext.slices(some, SLICE_BYTES):
                for a in range(x, y, SLICE_TEXTS):
                    b = min(y, a + SLICE_TEXTS)
                    sig, plain, which = both_signatures(*weighted(arrowtext.split(some.slice(a, b - a))), b - a, LONG)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *_binary(sig.astype(np.uint8), plain.astype(np.uint8), which)],
                                                     names=["node", "long", "long_plain"])

    return arrow_map(texts.select("node", "text"), run, "node long, long binary, long_plain binary")


def _company(rows: DataFrame, of: DataFrame) -> DataFrame:
    """``rows`` (node, key) of the buckets that hold several classes, with class, n: the nodes of the
    bucket, major: those of its largest class."""
    rows = written(rows.join(of, "node", "left").withColumn("class", F.coalesce("class", "node")), rows.count())
    sizes = (rows.groupBy("key", "class").agg(F.count("*").alias("n")).groupBy("key")
             .agg(F.sum("n").alias("n"), F.max("n").alias("major")).where("major < n"))
    return written(rows.join(sizes, "key"), rows.count())


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key (column 0) of sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        at = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for x, y in zip(at[:-1], at[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != key[x]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _registers(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The long signatures, and those with weights 1."""
    first, second = (rows.column(c).combine_chunks() for c in ("long", "long_plain"))
    return tuple(np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(rows.num_rows, -1) for c in (first, _plain(first, second)))


class _Agreed:
    """Which of some texts have long signatures that agree enough with a text's."""

    def __init__(self, rows: pa.Table):
        first, second = _registers(rows)
        kinds = [first] if (first == second).all() else [first, second]
        self.kinds = [(np.ascontiguousarray(sig[:, :HEAD]), sig) for sig in kinds]

    def __call__(self, i: int, among: np.ndarray) -> np.ndarray:
        """``among``: a flag for each text."""
        found = np.zeros(len(among), bool)
        for head, sig in self.kinds:
            some = np.flatnonzero(among & (np.count_nonzero(head == head[i], axis=1) >= LEAST_HEAD * HEAD))
            found[some[np.count_nonzero(sig[some] == sig[i], axis=1) >= LEAST_LONG * LONG]] = True
        return np.flatnonzero(found)


def _in_blocks(rows: DataFrame, blocks) -> DataFrame:
    """``rows`` with ``key`` replaced by one for each pair of blocks that a row's block is in; with one block
    nothing changes but the key."""
    block = F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1))
    rows = rows.withColumn("block", block).withColumn("other", other)
    return rows.withColumn("key", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))).drop("block", "other")


def _compared(rows: DataFrame, longer: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different classes in one bucket of ``rows`` whose long signatures agree enough; of
    these as many as connect all nodes that such pairs connect, so fewer than a bucket (or two blocks) has nodes."""
    rows = _in_blocks(rows, F.ceil(F.col("n") / FULL_NODES))
    whole = (rows.select("key", "node", "class").distinct().join(longer, "node").select("key", "node", "class", "long", "long_plain")
             .repartition("key").sortWithinPartitions("key", "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _by_key(batches):
            node, group = (bucket.column(c).to_numpy() for c in ("node", "class"))
            which, of_class, size = np.unique(group, return_inverse=True, return_counts=True)
            if len(which) < 2:
                continue
            agreed, pairs, root = _Agreed(bucket), [], np.arange(len(node))
            # all nodes but those of the largest class, which may be most, look for nodes of other classes
            for i in np.flatnonzero(of_class != size.argmax()):
                near = agreed(i, (of_class != of_class[i]) & (root != root[i]))
                roots, first = np.unique(root[near], return_index=True)
                pairs += [(node[i], node[near[j]]) for j in first]
                if len(roots):
                    root[np.isin(root, roots)] = root[i]
            if pairs:
                both = np.array(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(both.min(1)), pa.array(both.max(1))], names=["a", "b"])

    return arrow_map(whole, run, "a long, b long").distinct()


def _decided(candidates: DataFrame, of: DataFrame, texts: DataFrame, longer: DataFrame) -> DataFrame:
    """Links (a, b) between classes. Candidates connect texts into groups; a task takes a group, compares whole texts
    wherever long signatures agree enough and the classes are not yet one, and puts out the links that join two classes,
    fewer than the group has nodes."""
    groups = components(candidates).withColumnRenamed("class", "key")
    rows = groups.join(texts, "node").join(of, "node", "left").select("key", "node", F.coalesce("class", "node").alias("class"), "text")
    sizes = rows.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / GROUP_NODES), F.ceil(F.sum(F.octet_length("text")) / GROUP_BYTES)).alias("blocks"))
    whole = _in_blocks(rows.join(sizes, "key"), F.col("blocks")).join(longer, "node")
    whole = whole.select("key", "node", "class", "text", "long", "long_plain").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_key(batches):
            node, root = group.column("node").to_numpy(), np.unique(group.column("class").to_numpy(), return_inverse=True)[1]
            if root.max() == 0:
                continue
            agreed = _Agreed(group)
            texts = arrowtext.text_array(group.column("text"))
            sets: list = []
            for x, y in arrowtext.slices(texts, SLICE_BYTES):
                sets += _weighted_sets(texts.slice(x, y - x))
            pairs = []
            for i in range(len(node)):
                among = root != root[i]
                among[:i] = False
                for j in agreed(i, among):
                    if root[j] != root[i] and similarity(sets[i], sets[j]) >= THRESHOLD:
                        pairs.append((node[i], node[j]))
                        root[root == root[j]] = root[i]
            if pairs:
                both = np.array(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(both.min(1)), pa.array(both.max(1))], names=["a", "b"])

    return arrow_map(whole, run, "a long, b long").distinct()


def _only(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of the nodes in ``pairs``, so that a join moves these only."""
    ids = written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), 2 * pairs.count())
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "node", "left_semi")


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that agree in enough registers."""
    left = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa"), F.col("plain").alias("pa"))
    right = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb"), F.col("plain").alias("pb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb, x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in
                            (batch.column(2), batch.column(3), _plain(batch.column(2), batch.column(4)), _plain(batch.column(3), batch.column(5))))
            agreed = np.maximum((sa == sb).mean(1), (x == y).mean(1))
            yield batch.select(["a", "b"]).filter(pa.array(agreed >= LEAST_AGREED))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", "pa", "pb")
    return arrow_map(both, run, "a long, b long")


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """The greater of probability Jaccard and plain Jaccard of two weighted sets (sorted, counts)."""
    common, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    plain = len(common) / max(1, len(x[0]) + len(y[0]) - len(common))
    if plain >= THRESHOLD or not len(common) or (x[1].max() == 1 and y[1].max() == 1):
        return plain
    # sum over common d of 1 / sum over e of max(x_e / x_d, y_e / y_d); the inner sum is over all e,
    # split by which side is greater: e counts x_e / x_d where x_e / y_e > x_d / y_d
    a, b = x[1][i].astype(float), y[1][j].astype(float)
    only_x, only_y = x[1].sum() - a.sum(), y[1].sum() - b.sum()
    ratio = a / b
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    above = a.sum() - np.cumsum(a)
    below = np.cumsum(b)
    last = np.searchsorted(ratio, ratio, "right") - 1
    return max(plain, float((1 / ((only_x + above[last]) / a + (only_y + below[last]) / b)).sum()))


def _weighted_sets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    hashes, start = shingles(arrowtext.split(texts))
    return [np.unique(hashes[start[d]:start[d + 1]], return_counts=True) for d in range(len(texts))]


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs whose whole texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (arrowtext.text_array(batch.column(c)) for c in (2, 3))
            for a in range(0, batch.num_rows, 64):
                n = min(64, batch.num_rows - a)
                ok = [similarity(x, y) >= THRESHOLD for x, y in
                      zip(_weighted_sets(left.slice(a, n)), _weighted_sets(right.slice(a, n)), strict=True)]
                yield batch.slice(a, n).select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return arrow_map(both, run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, class) of all nodes that have a link to another; a class is its least node."""
    n = 2 * edges.count()
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), n)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("class")), n)
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), F.col("class").alias("other")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other")))
        lower = labels.join(near, "node").select("node", "class", F.least("class", "other").alias("low"))
        # a class's own class is nearer to the least node
        jump = labels.select(F.col("node").alias("low"), F.col("class").alias("lower"))
        moved = written(lower.join(jump, "low", "left")
                        .select("node", F.least("low", F.coalesce("lower", "low")).alias("class"),
                                (F.least("low", F.coalesce("lower", "low")) < F.col("class")).alias("moved")), n)
        labels = moved.select("node", "class")
        if not moved.where("moved").limit(1).count():
            return labels


def merged(of: DataFrame, links: DataFrame) -> DataFrame:
    """(node, class) after further links: components of the classes that they connect."""
    left, right = (of.select(F.col("node").alias(x), F.col("class").alias(f"c{x}")) for x in "ab")
    between = (links.join(left, "a", "left").join(right, "b", "left")
               .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    n = links.count()
    now = components(written(between, n)).select(F.col("node").alias("was"), F.col("class").alias("now"))
    moved = of.join(now, of["class"] == now["was"], "left").select("node", F.coalesce("now", "class").alias("class"))
    first = now.join(of, now["was"] == of["node"], "left_anti").select(F.col("was").alias("node"), F.col("now").alias("class"))
    return written(moved.unionByName(first), of.count() + 2 * n)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, id_key, text_key, n_words, node, class (the least node of its class; nodes
    are equal word sequences, null without words)."""
    checkpoint_dir(docs.sparkSession)
    rows = written(sketch(docs, id_col, text_col))
    nodes = written(rows.where("n_words > 0").groupBy("d1", "d2")
                    .agg(F.min(F.struct("id_key", "text_key")).alias("row"), F.first(F.struct("sig", "plain")).alias("sigs"))
                    .select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "row.id_key", "row.text_key", "sigs.sig", "sigs.plain"))
    n = nodes.count()
    keys = _band_keys(nodes)
    # a bucket's first hub has the least id: an original is closer to its copies than they are to each other
    hubs = written(keys.groupBy("key").agg(F.min_by("node", "age").alias("hub"), F.count("*").alias("n"))
                   .where("n > 1").select("key", "hub"), BANDS * n)
    active = written(keys.join(hubs, "key").select("node", "key", "hub"), 2 * BANDS * n)
    # whole texts of the nodes that have company in a bucket, one row's for each node
    wanted = written(active.select("node").distinct().join(nodes.select("node", "id_key", "text_key"), "node"), n)
    found = wanted.select("node", F.col("id_key").alias("want_id"), F.col("text_key").alias("want_text"))
    found = F.broadcast(found) if wanted.count() <= BROADCAST_ROWS else found
    text = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("want_id"), F.col(text_col).cast("string").alias("text"))
    texts = written(text.withColumn("want_text", F.xxhash64("text")).join(found, ["want_id", "want_text"]).select("node", "text"))

    def linked(some: DataFrame) -> DataFrame:
        some = written(some, n)
        near = written(_agreeing(some, _only(nodes, some)), some.count())
        return written(_verified(near, _only(texts, near)).distinct())

    # first a node tries the hub that it shares most buckets with
    shared = active.where("node != hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n"))
    of = components(linked(shared.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")))
    # what is left in several classes is compared in full
    rest = _company(active.select("node", "key"), of)
    if rest.limit(1).count():
        longer = written(_longer(texts.join(rest.select("node").distinct(), "node", "left_semi")))
        near = written(_compared(rest, longer))
        if near.limit(1).count():
            links = written(_decided(near, of, texts, longer))
            if links.limit(1).count():
                of = merged(of, links)
    member = nodes.select("node", "d1", "d2").join(of, "node", "left").select("node", "d1", "d2", F.coalesce("class", "node").alias("class"))
    return written(rows.select("doc_id", "id_key", "text_key", "n_words", "d1", "d2")
                   .withColumn("d1", F.when(F.col("n_words") > 0, F.col("d1"))).join(member, ["d1", "d2"], "left")
                   .select("doc_id", "id_key", "text_key", "n_words", "node", "class"), rows.count())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id of every row."""
    rows = classes(docs, id_col, text_col)
    least = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return (rows.join(least, "class", "left")
            .select("doc_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one of each class: that of the least id (of equal ids
    the least hash of the text). Texts without words all stay."""
    rows = classes(docs, id_col, text_col)
    kept = (rows.where("class is not null").groupBy("class").agg(F.min(F.struct("id_key", "text_key")).alias("row"))
            .select("row.id_key", "row.text_key"))
    wordless = rows.where("class is null").select("id_key", "text_key").distinct()
    stay = kept.withColumn("alone", F.lit(False)).unionByName(wordless.withColumn("alone", F.lit(True)))
    struct = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id_key"),
                         F.xxhash64(F.col(text_col).cast("string")).alias("text_key"))
    # of rows equal in id and text one stays, if it has words
    return (struct.join(stay, ["id_key", "text_key"])
            .withColumn("own", F.when(F.col("alone"), F.monotonically_increasing_id()))
            .dropDuplicates(["id_key", "text_key", "own"]).select("row.*"))
