"""Personal data by weak supervision.

Base patterns give spans that always stay. Looser patterns give further candidates, which may overlap each other:
spelled-out addresses, telephone numbers without a country code, four-part numbers, and groups of digits inside longer
ones. Regular-expression, gazetteer and context labelers vote on every candidate (1 for, 2 against, 0 abstains); each
abstains where it knows nothing. How often each combination of votes occurs in the whole corpus is counted by
Spark; expectation-maximisation over this table (its size is bounded by the labelers, not the data)
estimates every labeler's reliability and each combination's probability. A logistic classifier is trained on these
probabilities, from the votes and from the text itself: hashed words around a candidate and character trigrams of its form.
Its training rows are the SAMPLE candidates of least hash (distinct contexts with their numbers), a documented bound. It judges
all candidates; of those that overlap, the most probable one is added, if it is accepted.

Defined results: a null or empty text has no spans; equal rows give equal rows; offsets are code
points, ends exclusive. No added span overlaps a base span. Among equally probable candidates the first, then the longest,
counts. Without any candidate in the corpus nothing is added.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namekit.llm import arrowtext
from namekit.llm.tables import arrow_map

KINDS = ("email", "ip", "card", "phone")
SLICE_BYTES = 2 << 20

# Base patterns. A digit run's later starts and shorter ends can never match where the whole run
# does not, so look-behinds and possessive repeats change no match but keep the time linear.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Looser patterns.
_AT = re.compile(r" ?[\[({<]at[\])}>] ?", re.I)
_AT_WORD = re.compile(r" at ", re.I)
_SPELLED = re.compile(r"[A-Za-z0-9-]++(?:(?: ?[\[({<]dot[\])}>] ?| dot |\.)[A-Za-z0-9-]++)+", re.I)
_DOT = re.compile(r"[\[({<]dot[\])}>]| dot ", re.I)
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")
_GROUP = re.compile(r"[0-9]++")

# Gazetteers and cue words.
TOP_DOMAINS = frozenset("com net org edu gov info io de fr es uk eu us".split())
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38")
CUES = {
    "email": frozenset("mail email contact write reach correo courriel kontakt schreiben escribir contacter".split()),
    "ip": frozenset("ip host server address login client adresse direccion serveur servidor".split()),
    "card": frozenset("card visa mastercard amex payment credit debit karte carte tarjeta kreditkarte".split()),
    "phone": frozenset("phone tel call fax mobile cell telephone telefon telefono appel ruf llame handy".split()),
}
AGAINST = frozenset("version release isbn section chapter order invoice id serial build figure page table rechnung facture "
                    "pedido bestellung commande numero number nr no part ticket".split())
_WORD = re.compile(r"[^\W\d_]+")
CONTEXT = 40
#: Characters in which another span of personal data counts as company.
NEAR = 120

#: Names of the labelers, in the order of their votes.
LABELERS = ("form", "gazetteer", "cue", "against", "edges", "company")

#: Buckets of hashed text features, and training rows of the classifier.
BUCKETS = 1 << 13
SAMPLE = 20_000


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def _back(text: str, at: int, floor: int) -> int:
    """Where the run of local-part characters that ends at ``at`` begins."""
    while at > floor and text[at - 1] in _LOCAL:
        at -= 1
    return at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order."""
    out = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            begin, end = _back(text, at, done), 0
            if begin < at and (m := _DOMAIN.match(text, at + 1)):
                end = done = m.end()
                out.append((begin, 0, end))
            else:
                done = at + 1
            at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGIT.sub("", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text)
                    if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates, in order, that overlap no base span; they may overlap each other."""
    found = set()
    ats = [(m, False) for m in _AT.finditer(text)] if "[" in text or "(" in text or "{" in text or "<" in text else []
    if "dot" in text or "DOT" in text or "Dot" in text:
        ats += [(m, True) for m in _AT_WORD.finditer(text)]
    for m, spelled in ats:
        begin = _back(text, m.start(), 0)
        tail = _SPELLED.match(text, m.end())
        if begin < m.start() and tail and (not spelled or _DOT.search(tail.group())):
            found.add((begin, 0, tail.end()))
    if _DIGIT.search(text):
        if "." in text:
            found.update((m.start(), 1, m.end()) for m in _IP.finditer(text))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                groups = [g.span() for g in _GROUP.finditer(text, m.start(), m.end())]
                for i in range(len(groups)):  # groups of three digits or more, of 13 to 19 digits together
                    digits = 0
                    for a, b in groups[i:i + 6]:
                        digits += b - a
                        if digits > 19 or b - a < 3:
                            break
                        if digits >= 13:
                            found.add((groups[i][0], 2, b))
        found.update((m.start(), 3, m.end()) for m in _LOCAL_PHONE.finditer(text))
    out, b = [], 0
    for s, k, e in sorted(found):
        while b < len(base) and base[b][2] <= s:
            b += 1
        if all(e <= x or y <= s for x, _, y in base[b:b + 8]):
            out.append((s, k, e))
    return out


def votes(text: str, span: tuple[int, int, int], is_base: bool, base: list[tuple[int, int, int]]) -> tuple[int, ...]:
    """Each labeler's vote, 1 for, 2 against, 0 abstains."""
    s, k, e = span
    kind, value = KINDS[k], text[s:e]
    digits = _NOT_DIGIT.sub("", value)
    before = [w.lower() for w in _WORD.findall(text[max(0, s - CONTEXT):s])]
    after = [w.lower() for w in _WORD.findall(text[e:e + CONTEXT])]
    if k == 0:
        form = 1 if "@" in value or _AT.search(value) else 0
        gazetteer = 1 if re.split(r"[^a-z]+", value.lower().rstrip(")]}>"))[-1] in TOP_DOMAINS else 2
    elif k == 1:
        form = 1 if all(map(_small, value.split("."))) else 2
        gazetteer = 2 if value.split(".")[0].lstrip("0") in ("", "127", "255") else 0
    elif k == 2:
        form = 1 if luhn(digits) else 2
        gazetteer = 1 if digits.startswith(CARD_PREFIXES) else 2
    else:
        form = 1 if value[0] == "+" or value[0] == "(" or len(digits) == 10 else 0
        gazetteer = 1 if value[0] == "+" else 2 if digits[0] == "1" and len(digits) < 11 else 0
    cue = 1 if any(w in CUES[kind] for w in before[-5:] + after[:3]) else 0
    against = 2 if any(w in AGAINST for w in before[-2:]) else 0
    around = text[max(0, s - 1):s] + text[e:e + 1]
    edges = 2 if any(c.isalnum() or c in "$€£%#=/" for c in around) else 0
    company = 1 if any(x[0] != s and x[0] < e + NEAR and s - NEAR < x[2] for x in base) else 0
    return (1 if is_base else form), gazetteer, cue, against, edges, company


def text_features(text: str, span: tuple[int, int, int]) -> list[int]:
    """Hashed words on either side and character trigrams of the form (9 a digit, a a letter), with the kind."""
    s, k, e = span
    form = "^" + re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", text[s:e]))[:60] + "$"
    names = {f"{k}f{form[i:i + 3]}" for i in range(len(form) - 2)} | {f"{k}n{min(e - s, 40)}"}
    names |= {f"{k}b{w.lower()}" for w in _WORD.findall(text[max(0, s - CONTEXT):s])[-4:]}
    names |= {f"{k}a{w.lower()}" for w in _WORD.findall(text[e:e + CONTEXT])[:3]}
    names |= {f"{k}l{text[max(0, s - 2):s]}", f"{k}r{text[e:e + 2]}"}
    return sorted({zlib.crc32(n.encode()) % BUCKETS for n in names})


def _candidates(text: str) -> Iterator[tuple[tuple, tuple[int, int, int]]]:
    """((kind, votes...), span) of all candidates."""
    base = base_spans(text)
    for found, is_base in ((base, True), (loose_spans(text, base), False)):
        for span in found:
            yield (span[1], *votes(text, span, is_base, base)), span


def vote_counts(docs: DataFrame, text_col: str = "text") -> list[tuple[tuple, int]]:
    """((kind, votes...), number) over all candidates of the corpus."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            texts = arrowtext.text_array(batch.column(0))
            for a, b in arrowtext.slices(texts, SLICE_BYTES):
                for text in texts.slice(a, b - a).to_pylist():
                    for key, _ in _candidates(text):
                        seen[",".join(map(str, key))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                         names=["pattern", "n"])

    # at most kinds x 3^labelers rows
    table = arrow_map(rows, run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return sorted((tuple(map(int, r.pattern.split(","))), r.n) for r in table.collect())


def samples(docs: DataFrame, text_col: str = "text", most: int = SAMPLE) -> list[tuple[tuple, list[int], int]]:
    """(key, text features, number) of the distinct contexts of least hash, ``most`` at most: every task keeps that many."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        heap: list[int] = []
        for batch in batches:
            texts = arrowtext.text_array(batch.column(0))
            for a, b in arrowtext.slices(texts, SLICE_BYTES):
                for text in texts.slice(a, b - a).to_pylist():
                    for key, span in _candidates(text):
                        features = text_features(text, span)
                        name = ",".join(map(str, key))
                        h = int.from_bytes(hashlib.blake2b(f"{name};{features}".encode(), digest_size=8).digest(), "little", signed=True)
                        if h in kept:
                            kept[h][2] += 1
                        elif len(heap) < most or h < -heap[0]:
                            kept[h] = [name, features, 1]
                            heapq.heappush(heap, -h)
                            if len(heap) > most:
                                del kept[-heapq.heappop(heap)]
        names, features, n = zip(*kept.values(), strict=True) if kept else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.array(names, pa.string()),
                                          pa.array(features, pa.list_(pa.int32())), pa.array(n, pa.int64())], names=["h", "pattern", "features", "n"])

    table = (arrow_map(rows, run, "h long, pattern string, features array<int>, n long").groupBy("h")
             .agg(F.first("pattern").alias("pattern"), F.first("features").alias("features"), F.sum("n").alias("n"))
             .orderBy("h").limit(most))
    return [(tuple(map(int, r.pattern.split(","))), list(r.features), r.n) for r in table.collect()]


class SpanModel:
    """Reliabilities of the labelers, from counts of vote combinations, and the span classifier."""

    ROUNDS = 60
    STEPS = 300

    def __init__(self, counts: list[tuple[tuple, int]], rows: list[tuple[tuple, list[int], int]]):
        self.reliability: dict[str, tuple[float, float]] = {}
        self.posterior: dict[tuple, float] = {}
        self.votes, self.words = np.zeros(0), np.zeros(0)
        if counts:
            keys = np.array([k for k, _ in counts])
            n = np.array([c for _, c in counts], float)
            share = self._reconcile(keys[:, 1:], n)
            self.posterior = {tuple(map(int, k)): float(p) for k, p in zip(keys, share, strict=True)}
            self._fit(rows)

    @staticmethod
    def _sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _reconcile(self, v: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probability that each combination is personal data: expectation-maximisation over
        labelers that are independent given the truth, begun at the majority vote."""
        share = ((v == 1).sum(1) + 0.5) / ((v > 0).sum(1) + 1)
        for _ in range(self.ROUNDS):
            prior = (n @ share + 1) / (n.sum() + 2)
            log = np.full((len(v), 2), [np.log(1 - prior), np.log(prior)])
            for j, name in enumerate(LABELERS):
                for truth, weight in ((0, n * (1 - share)), (1, n * share)):
                    # how often it votes each way, smoothed towards being right more often than wrong
                    hope = np.array([2.0, 2.0, 1.0]) if truth else np.array([2.0, 1.0, 2.0])
                    p = hope + np.array([weight[v[:, j] == x].sum() for x in range(3)])
                    p /= p.sum()
                    log[:, truth] += np.log(p[v[:, j]])
                    if truth:
                        sensitivity = p[1] / (p[1] + p[2])
                    else:
                        specificity = p[2] / (p[1] + p[2])
                self.reliability[name] = (float(sensitivity), float(specificity))
            new = self._sigmoid(log[:, 1] - log[:, 0])
            if np.abs(new - share).max() < 1e-9:
                break
            share = new
        return share

    @staticmethod
    def features(key) -> np.ndarray:
        kind, *v = (int(x) for x in key)
        return np.array([1.0, *(kind == k for k in range(len(KINDS))), *(x == y for x in v for y in (1, 2))], float)

    def _fit(self, rows: list[tuple[tuple, list[int], int]]) -> None:
        """Logistic regression on the probabilities of the votes, by gradients scaled to their past size, with a ridge."""
        x = np.stack([self.features(k) for k, _, _ in rows])
        y = np.array([self.posterior[k] for k, _, _ in rows])
        weight = np.array([math.sqrt(n) for _, _, n in rows])
        weight /= weight.sum()
        at = np.repeat(np.arange(len(rows)), [len(f) for _, f, _ in rows])
        word = np.array([f for _, fs, _ in rows for f in fs], np.int64)
        each = 1 / np.sqrt(np.maximum(1, np.bincount(at, minlength=len(rows))))[at]
        self.votes, self.words = np.zeros(x.shape[1]), np.zeros(BUCKETS)
        past_v, past_w = np.full(x.shape[1], 1e-8), np.full(BUCKETS, 1e-8)
        for _ in range(self.STEPS):
            z = x @ self.votes + np.bincount(at, self.words[word] * each, minlength=len(rows))
            off = weight * (self._sigmoid(z) - y)
            slope_v = x.T @ off + 1e-4 * self.votes
            slope_w = np.bincount(word, off[at] * each, minlength=BUCKETS) + 1e-4 * self.words
            past_v += slope_v ** 2
            past_w += slope_w ** 2
            self.votes -= 0.3 * slope_v / np.sqrt(past_v)
            self.words -= 0.3 * slope_w / np.sqrt(past_w)

    def probability(self, text: str, span: tuple[int, int, int], key: tuple) -> float:
        if not len(self.votes):
            return 0.0
        of = text_features(text, span)
        return float(self._sigmoid(self.features(key) @ self.votes + self.words[of].sum() / math.sqrt(len(of))))

    def spans(self, text: str) -> tuple[list, list]:
        """Base spans and those added."""
        base = base_spans(text)
        judged = [(-self.probability(text, s, (s[1], *votes(text, s, False, base))), s[0], -s[2], s) for s in loose_spans(text, base)]
        added: list = []
        for p, _, _, span in sorted(judged):
            at = bisect.bisect(added, span)
            if -p >= 0.5 and (at == 0 or added[at - 1][2] <= span[0]) and (at == len(added) or span[2] <= added[at][0]):
                added.insert(at, span)
        return base, added


def train(docs: DataFrame, text_col: str = "text") -> SpanModel:
    return SpanModel(vote_counts(docs, text_col), samples(docs, text_col))


def _joined(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def find(docs: DataFrame, model: SpanModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans (all of them),
    n_added. Without a model one is trained on ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = arrowtext.text_array(batch.column(1))
            for a, b in arrowtext.slices(texts, SLICE_BYTES):
                found = [shared.value.spans(t) for t in texts.slice(a, b - a).to_pylist()]
                columns = {"doc_id": batch.column(0).slice(a, b - a)}
                for k, kind in enumerate(KINDS):
                    columns[f"n_{kind}"] = pa.array([sum(x[1] == k for x in base) for base, _ in found], pa.int64())
                columns["base_sha256"] = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string())
                columns["spans"] = pa.array([_joined(sorted(base + more)) for base, more in found], pa.string())
                columns["n_added"] = pa.array([len(more) for _, more in found], pa.int64())
                yield pa.RecordBatch.from_pydict(columns)

    return arrow_map(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                "base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, model: SpanModel | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind, like ``[EMAIL]``; null texts stay null. Where
    base spans of different kinds overlap, the text from the first start to the last end goes."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, text_col))
    column = docs.columns.index(text_col)

    def clean(text: str) -> str:
        base, more = shared.value.spans(text)
        if not base and not more:
            return text
        out, done = [], 0
        for s, k, e in sorted(base + more):
            if s >= done:
                out += [text[done:s], f"[{KINDS[k].upper()}]"]
            done = max(done, e)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column)
            whole = arrowtext.text_array(texts)
            for a, b in arrowtext.slices(whole, SLICE_BYTES):
                new = [None if t is None else clean(t) for t in texts.slice(a, b - a).to_pylist()]
                yield batch.slice(a, b - a).set_column(column, batch.schema.field(column), pa.array(new, texts.type))

    return arrow_map(docs, run, docs.schema)
