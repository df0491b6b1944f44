"""Problem 9: subject areas of each document.

One-versus-rest linear classifiers on hashed word n-grams score sentences; a document
has the subjects that enough of its sentences deal with.  The labels are weak: every
sentence of a labelled example carries the example's subject, though many are of no subject
at all.  Section titles and addresses carry no subject here, so after a first fit the documents
lend theirs: a bounded sample, chosen by hash, is scored, and the sentences of documents with
one leading subject join the training rows, which teaches words no example has.

Bounds: ``max_examples`` labelled rows and ``sample_documents`` documents with SAMPLE_SENTENCES
sentences each, drawn by hash from the whole text, are used for fitting; every document is scored
in whole, once. The cut-offs come from a histogram of the scores of all sentences of all documents, the
share from which a subject counts from the shares of all documents; only the cut-offs that choose
the lending documents between the rounds come from the sample.

All work on texts goes by Arrow batch: sentences are joined, folded and cut into words together,
n-grams are hashed and scored as arrays.

NULL and blank texts have no subject. Damaged text is mended as far as it goes (mojibake,
accents, case, widths, invisible characters) before features are taken.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .sentences import split_batch

BITS = 18
SHARE = (1 / 9, 1 / 5)  # a subject met in that part of the sentences or fewer is only mentioned; about that part or more, it counts
MAX_EXAMPLES = 20_000
SAMPLE_DOCUMENTS = 6_000  # and half as many each of texts without English words and in scripts without spaces
SAMPLE_SENTENCES = 16
ROUNDS = 3
LEAD = 0.3  # a document lends its leading subject if that has such a share of its sentences
BIN = 1 / 256  # width of a score bin of the calibration
BINS = 2 * 64 * 256  # from -64 to 64; the bins at the ends count what lies beyond
LEAST_COUNT = 4  # rarer features (names, numbers) are not learned
KNOWN_WORDS = 1 << 18  # words whose hash a worker keeps

_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]")
_SCRIPTS = re.compile(r"[぀-ゟ]+|[゠-ヿ]+|[^぀-ヿ]+")
_TOKEN = re.compile(r"\w+(?:-\w*\d\w*)?|\x00")
_LETTERS = re.compile(r"[^\W\d_]+")
_MOJIBAKE = re.compile(r"[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]+")


def _mend(m: re.Match) -> str:
    for name in ("latin-1", "cp1252"):
        try:
            return m.group().encode(name).decode("utf-8")
        except UnicodeError:
            continue
    return m.group()


def fold(text: str) -> str:
    """One spelling for damaged, accented, wide and upper-case variants."""
    text = _MOJIBAKE.sub(_mend, text)
    text = unicodedata.normalize("NFKD", text.replace("\u200b", "").replace("\ufeff", "").replace("\u00ad", ""))
    text = re.sub("[\u0300-\u036f]", "", text)
    return unicodedata.normalize("NFC", text).casefold()


_CLOSING = "\"'”’»)]*_"
_ENDS = frozenset(".!?…。！？।؟")


def sentences_of_batch(texts: list[str | None]) -> list[list[str]]:
    """Sentences of each text; headings and other lines that are no sentence are left out."""
    out: list[list[str]] = []
    for t, units in zip(texts, split_batch(texts), strict=True):
        keep = []
        for a, b in units:
            s = t[a:b]
            ended = s.rstrip(_CLOSING)[-1:] in _ENDS
            if s[0] != "#" and (ended or len(s.split()) > 6 or _WIDE.search(s)):
                keep.append(s)
        out.append(keep)
    return out


class _Words(dict):
    """Hash of a word; -1 for words of scripts without spaces, -2 for the mark between sentences, -3 for codes and numbers."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = self.value(word)
        return value

    @staticmethod
    def value(word: str) -> int:
        if word == "\x00":
            return -2
        if _WIDE.search(word):
            return -1
        if not word.isalpha():
            letters = _LETTERS.findall(word)
            if len(letters) != 1 or word[0].isascii() and word[0].isalpha() and any(map(str.isdigit, word)):
                return -3  # "req-12", "v7a"
            word = letters[0]
        return zlib.crc32(word.encode())


_WORDS = _Words()
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93], np.uint64)


def _slot(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX[salt]
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def pieces(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """Batches of at most ``rows`` rows, whatever the session's setting: their n-grams are held together."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


@dataclass
class Bag:
    """Distinct feature slots of many sentences, one after the other; a sentence without features has length 0."""

    slots: np.ndarray
    lengths: np.ndarray

    def __len__(self) -> int:
        return len(self.lengths)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def take(self, keep: np.ndarray) -> Bag:
        return Bag(self.slots[np.repeat(keep, self.lengths)], self.lengths[keep])

    @staticmethod
    def of(parts: list[Bag]) -> Bag:
        none = np.zeros(0, np.int64)
        return Bag(np.concatenate([none, *(p.slots for p in parts)]), np.concatenate([none, *(p.lengths for p in parts)]))


def features(sentences: list[str]) -> Bag:
    """Slots of the word uni- and bigrams; scripts without spaces give character 2- to 4-grams."""
    n = len(sentences)
    if not n:
        return Bag(np.zeros(0, np.int64), np.zeros(0, np.int64))
    text = fold("\x00".join(s.replace("\x00", " ") for s in sentences))
    tokens = _TOKEN.findall(text)
    found = np.fromiter(map(_WORDS.__getitem__, tokens), np.int64, len(tokens))
    owner = np.cumsum(found == -2)
    plain = found >= 0
    words, of = found[plain].astype(np.uint64), owner[plain]
    pairs = of[1:] == of[:-1]
    both = (words[:-1] * _MIX[0] + words[1:])[pairs]
    keys = [of << BITS | _slot(words, 2), of[1:][pairs] << BITS | _slot(both, 1)]
    if len(wide := np.nonzero(found == -1)[0]):
        parts, owners = [], []
        for i in wide.tolist():
            found_parts = [part for run in _LETTERS.findall(tokens[i]) for part in _SCRIPTS.findall(run)]
            parts += found_parts
            owners += [owner[i]] * len(found_parts)
        sizes = np.array([len(x) for x in parts])
        owners = np.array(owners)
        long = sizes > 4
        whole = np.array([zlib.crc32(x.encode()) for x in parts if len(x) > 4], np.uint64)
        keys.append(owners[long] << BITS | _slot(whole, 3))
        chars = np.frombuffer("\x00".join([*parts, ""]).encode("utf-32-le"), np.uint32).astype(np.uint64)
        whose = np.repeat(owners, sizes + 1)
        grams, inside = chars, chars != 0
        for k in range(1, 4):
            grams = grams[:-1] * _MIX[0] + chars[k:]
            inside = inside[:-1] & (chars[k:] != 0)
            keys.append(whose[:-k][inside] << BITS | _slot(grams[inside], 0))
    key = np.sort(np.concatenate(keys))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return Bag(key & ((1 << BITS) - 1), np.bincount(key >> BITS, minlength=n))


@dataclass
class Model:
    subjects: list[str]
    slots: np.ndarray  # sorted slots with a weight
    weights: np.ndarray  # subjects x slots
    bias: np.ndarray
    cutoff: np.ndarray  # calibrated score from which a sentence deals with the subject
    place: np.ndarray = field(default=None, repr=False)  # slot -> row of weights, -1 for none

    def __post_init__(self) -> None:
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[self.slots] = np.arange(len(self.slots), dtype=np.int32)

    def matrix(self, bag: Bag) -> np.ndarray:
        """Score of every sentence for every subject."""
        scores = np.tile(self.bias.astype(np.float32)[:, None], len(bag))
        at = self.place[bag.slots]
        hit = at >= 0
        rows, at = bag.owner[hit], at[hit]
        if len(rows):
            starts = np.nonzero(np.r_[True, rows[1:] != rows[:-1]])[0]
            for own, w in zip(scores, self.weights, strict=True):  # a subject at a time: contiguous sums are several times as fast
                own[rows[starts]] += np.add.reduceat(w[at], starts)
        return scores.T

    def labels(self, bag: Bag) -> np.ndarray:
        """Subject of each sentence, -1 for none: the best one, if above its cut-off."""
        scores = self.matrix(bag)
        if not scores.size:
            return np.full(len(bag), -1)
        best = scores.argmax(axis=1)
        return np.where(scores.max(axis=1) > self.cutoff[best], best, -1)

    def keys(self, bag: Bag) -> np.ndarray:
        """Best subject and bin of its score, as one number, of each sentence."""
        if not self.subjects or not len(bag):
            return np.zeros(0, np.int64)
        scores = self.matrix(bag)
        at = np.clip(np.floor(scores.max(axis=1) / BIN).astype(np.int64) + BINS // 2, 0, BINS - 1)
        return scores.argmax(axis=1) * BINS + at

    def least_keys(self) -> list[int]:
        """The first key of each subject that is above its cut-off."""
        bins = np.clip(np.ceil(self.cutoff / BIN).astype(np.int64) + BINS // 2, 0, BINS - 1)
        return [j * BINS + int(b) for j, b in enumerate(bins)]


def no_model() -> Model:
    return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0), np.zeros(0))


def fit(
    bag: Bag, labels: np.ndarray, counts: np.ndarray, subjects: list[str], least: int,
    epochs: int = 60, l2: float = 1e-2, rate: float = 0.5,
) -> Model:
    """One-versus-rest logistic regression by full-batch AdaGrad over distinct rows; ``counts`` says how often a row counts."""
    k = len(subjects)
    seen = np.bincount(bag.slots, np.repeat(counts, bag.lengths), minlength=1 << BITS)
    kept = seen[bag.slots] >= least
    lengths = np.bincount(bag.owner[kept], minlength=len(bag))
    bag = Bag(bag.slots[kept], lengths)
    some = lengths > 0
    bag, labels, counts = bag.take(some), labels[some], counts[some]
    if not len(bag):
        return Model(subjects, np.zeros(0, np.int64), np.zeros((k, 0), np.float32), np.zeros(k), np.zeros(k))
    starts = np.r_[0, np.cumsum(bag.lengths)[:-1]]
    marks = np.random.default_rng(0).integers(1, 1 << 63, 1 << BITS, np.uint64)  # rows with the same slots have the same sum
    alike = np.add.reduceat(marks[bag.slots], starts) + labels.astype(np.uint64) * _MIX[2]
    _, first, group = np.unique(alike, return_index=True, return_inverse=True)
    weight = np.bincount(group, counts)
    keep = np.zeros(len(bag), bool)
    keep[first] = True
    weight, labels = weight[group[keep]], labels[keep]
    bag = bag.take(keep)
    starts = np.r_[0, np.cumsum(bag.lengths)[:-1]]
    slots, inverse = np.unique(bag.slots, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    slot_start = np.searchsorted(inverse[order], np.arange(len(slots)))
    by_slot = bag.owner[order]
    w, b = np.zeros((k, len(slots)), np.float32), np.zeros(k, np.float32)
    for j in range(k):
        target = (labels == j).astype(np.float32)
        # A subject has a fraction of the rows: its own count as much as all others.
        share = target.mean()
        scale = np.where(target > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)) * weight
        scale = (scale / scale.mean() / len(bag)).astype(np.float32)
        own, gw, gb = w[j], np.full(len(slots), 1e-8, np.float32), 1e-8
        for _ in range(epochs):
            z = np.add.reduceat(own[inverse], starts) + b[j]
            g = (1 / (1 + np.exp(-z)) - target) * scale
            dw = np.add.reduceat(g[by_slot], slot_start) + np.float32(l2 / len(bag)) * own
            db = float(g.sum())
            gw += dw**2
            gb += db**2
            own -= np.float32(rate) * dw / np.sqrt(gw)
            b[j] -= rate * db / gb**0.5
    return Model(subjects, slots, w, b, np.zeros(k))


def drawn(units: list[str], key: str, most: int = SAMPLE_SENTENCES) -> list[str]:
    """At most ``most`` sentences, in order, chosen by hash from all of the text."""
    if len(units) <= most:
        return units
    order = sorted(range(len(units)), key=lambda i: hashlib.blake2b(f"{key} {i}".encode(), digest_size=8).digest())
    return [units[i] for i in sorted(order[:most])]


def valley(at: np.ndarray, n: np.ndarray) -> float:
    """The emptiest score between the two humps (no subject, some subject) of the counts ``n`` in the bins ``at``."""
    ends = (np.arange(BINS + 1) - BINS // 2) * BIN
    below = np.r_[0, np.cumsum(np.bincount(at, n, minlength=BINS))]
    bin_of = lambda q: max(0, int(np.searchsorted(below, q * below[-1])) - 1)
    if below[-1] < 50:
        return float(ends[bin_of(0.5)]) + BIN / 2 if below[-1] else 0.0
    lo, hi = ends[bin_of(0.01)], ends[bin_of(0.99) + 1]
    edges = np.linspace(lo, hi, 61)
    counts = np.convolve(np.diff(np.interp(edges, ends, below)), np.ones(5) / 5, "same")
    left = int(counts[:25].argmax())
    right = left + 8 + int(counts[left + 8 :].argmax())
    k = left + int(counts[left:right].argmin())
    return float(edges[k] + edges[k + 1]) / 2


def calibrate(model: Model, counted: Counter, least: int = 300, drift: float = 0.7) -> None:
    """Cut-off of each subject: the valley of the scores it wins, near the common valley."""
    if not counted:
        return
    keys = np.array(sorted(counted))
    n = np.array([counted[x] for x in keys.tolist()])
    best, at = np.divmod(keys, BINS)
    common = valley(at, n)
    model.cutoff = np.full(len(model.subjects), common)
    for j in range(len(model.subjects)):
        own = best == j
        if n[own].sum() >= least:
            model.cutoff[j] = np.clip(valley(at[own], n[own]), common - drift, common + drift)


@dataclass
class Sample:
    """Sentences of sampled documents: all features, and how many sentences each document has."""

    bag: Bag
    sizes: np.ndarray


def score_counts(model: Model, bag: Bag) -> Counter:
    """How many sentences have their best score in each bin; keys are subject * BINS + bin."""
    keys, n = np.unique(model.keys(bag.take(bag.lengths > 0)), return_counts=True)
    return Counter(dict(zip(keys.tolist(), n.tolist(), strict=True)))


def leading(model: Model, sample: Sample, first_turn: bool) -> np.ndarray:
    """Subject each sampled document lends, -1 for none."""
    k, docs = len(model.subjects), len(sample.sizes)
    owner = np.repeat(np.arange(docs), sample.sizes)
    if first_turn:
        odds = 1 / (1 + np.exp(-model.matrix(sample.bag)))
        score = np.column_stack([np.bincount(owner, odds[:, j], minlength=docs) for j in range(k)])
        score /= np.maximum(sample.sizes, 1)[:, None]
    else:
        got = model.labels(sample.bag)
        score = np.bincount(owner[got >= 0] * k + got[got >= 0], minlength=docs * k).reshape(docs, k)
    best = score.argmax(axis=1)
    first = score[np.arange(docs), best]
    second = np.sort(score, axis=1)[:, -2] if k > 1 else np.zeros(docs)
    sure = first - second >= 0.1 if first_turn else (first >= LEAD * sample.sizes) & (second <= LEAD * first * 1.15)
    return np.where(sure & (sample.sizes >= 3), best, -1)


def train(examples: list[tuple[str, Bag]], sample: Sample, rounds: int = ROUNDS) -> Model:
    """Fit on labelled examples, then let sampled documents lend their leading subject."""
    subjects = sorted({s for s, _ in examples})
    rows = Bag.of([b for _, b in examples])
    labels = np.repeat([subjects.index(s) for s, _ in examples], [len(b) for _, b in examples]).astype(np.int64)
    some = rows.lengths > 0
    rows, labels = rows.take(some), labels[some]
    model = fit(rows, labels, np.ones(len(rows)), subjects, 2, epochs=40, l2=1e-1)
    calibrate(model, score_counts(model, sample.bag if len(sample.bag) else rows))
    for turn in range(rounds if len(sample.bag) else 0):
        lent = np.repeat(leading(model, sample, not turn), sample.sizes)
        model = fit(
            Bag.of([rows, sample.bag.take(lent >= 0)]), np.r_[labels, lent[lent >= 0]],
            np.r_[np.full(len(rows), 3.0), np.ones((lent >= 0).sum())], subjects, LEAST_COUNT,
        )
        calibrate(model, score_counts(model, sample.bag))
    return model


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, keys``: best subject and score bin of every sentence of every document with a text."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: features seen often in a bounded sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches):
            split = sentences_of_batch(pdf["t"].tolist())
            bag = features([x for xs in split for x in xs])
            some = bag.lengths > 0
            keys = shared.value.keys(bag.take(some)).astype(np.int32)
            per_doc = np.bincount(np.repeat(np.arange(len(split)), [len(xs) for xs in split])[some], minlength=len(split))
            ends = np.cumsum(per_doc)[:-1] if shared.value.subjects else np.zeros(len(split) - 1, np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "keys": np.split(keys, ends)})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    return rows.mapInPandas(run, f"doc_id {kind}, keys array<int>")


def count_scores(rows: DataFrame) -> Counter:
    """``score_counts`` of all sentences of ``scored`` documents; the driver gets at most BINS counts a subject."""
    counted = rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return Counter({r["key"]: r["n"] for r in counted.collect()})


def _level(key: Column) -> Column:
    """Leading zeros of a hash: half of all keys have one or more, a quarter two or more ..."""
    return 64 - F.length(F.bin(F.xxhash64(key)))


def hash_sample(rows: DataFrame, key: str, stratum: Column, most: dict[str, int]) -> DataFrame:
    """At most ``most`` rows of each stratum (and, if it has so many, at least about half of that), the same ones every time."""
    marked = rows.withColumn("_stratum", stratum).withColumn("_level", _level(F.col(key)))
    counts = marked.groupBy("_stratum", "_level").agg(F.count(F.lit(1)).alias("n")).collect()  # 65 levels a stratum
    keep = F.lit(False)
    for name, limit in most.items():
        by_level = {r["_level"]: r["n"] for r in counts if r["_stratum"] == name}
        total, least = 0, 65
        for level in sorted(by_level, reverse=True):
            total += by_level[level]
            if total > limit:
                break
            least = level
        keep = keep | ((F.col("_stratum") == name) & (F.col("_level") >= least))
    return marked.where(keep).drop("_stratum", "_level")


def fit_subjects(
    docs: DataFrame, examples: DataFrame, doc_id: str = "doc_id", text: str = "text",
    max_examples: int = MAX_EXAMPLES, sample_documents: int = SAMPLE_DOCUMENTS,
) -> Model:
    """The model with cut-offs of the sample; what reaches the driver is bounded by the parameters.

    Examples with NULL subject or text are left out; beyond ``max_examples`` those first by hash stay.
    Without examples there are no subjects.
    """
    labelled = examples.where(F.col("subject").isNotNull() & F.col("text").isNotNull()).select("subject", "text")
    labelled = labelled.orderBy(F.xxhash64("subject", "text"), "subject", "text").limit(max_examples)
    chosen = sorted((r["subject"], r["text"]) for r in labelled.collect())
    split = sentences_of_batch([t for _, t in chosen])
    known = [(s, features(xs)) for (s, _), xs in zip(chosen, split, strict=True)]
    if not known:
        return no_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches):
            split = [drawn(xs, d) for d, xs in zip(pdf["d"], sentences_of_batch(pdf["t"].tolist()), strict=True)]
            sizes = [len(xs) for xs in split]
            bag = features([x for xs in split for x in xs])
            some = bag.lengths > 0
            per_doc = np.bincount(np.repeat(np.arange(len(split)), sizes)[some], minlength=len(split))
            bag = bag.take(some)
            lengths = np.split(bag.lengths.astype(np.int32), np.cumsum(per_doc)[:-1])
            tokens = [int(x.sum()) for x in lengths]
            slots = np.split(bag.slots.astype(np.int32), np.cumsum(tokens)[:-1])
            yield pd.DataFrame({"d": pdf["d"], "slots": slots, "lengths": lengths})

    texts = docs.select(F.col(doc_id).cast("string").alias("d"), F.col(text).alias("t")).where(F.length("t") > 40)
    # Rare languages have strata of their own, else the sample would hardly teach their words.
    stratum = F.when(F.col("t").rlike("[\\u3040-\\u30ff\\u3400-\\u9fff]"), "wide").when(
        F.col("t").rlike("(?i)\\b(the|is|was|has|once|and)\\b"), "english"
    )
    half = sample_documents // 2
    sample = hash_sample(texts, "d", stratum.otherwise("other"), {"english": sample_documents, "other": half, "wide": half})
    rows = sorted(sample.mapInPandas(run, "d string, slots array<int>, lengths array<int>").collect(), key=lambda r: r["d"] or "")
    bags = [Bag(np.array(r["slots"], np.int64), np.array(r["lengths"], np.int64)) for r in rows]
    return train(known, Sample(Bag.of(bags), np.array([len(b) for b in bags], np.int64)))


def subject_shares(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, subject, share``: share of a document's sentences that deal with each subject it meets.

    Every document is scored once and its scores are kept in the shared folder; the cut-offs are then
    calibrated on all of them.
    """
    rows = cut_lineage(scored(docs, model, doc_id, text))
    if model.subjects:
        calibrate(model, count_scores(rows))

    def met(subject: str, low: int, high: int) -> Column:
        return F.struct(F.lit(subject).alias("subject"), F.size(F.filter("keys", lambda x: (x >= low) & (x < high))).alias("n"))

    lows = model.least_keys()
    found = F.array(*[met(s, a, (j + 1) * BINS) for j, (s, a) in enumerate(zip(model.subjects, lows, strict=True))])
    found = found.cast("array<struct<subject:string,n:int>>")
    rows = rows.select("doc_id", F.size("keys").alias("_all"), F.explode(found).alias("m")).where("m.n > 0")
    return rows.select("doc_id", F.col("m.subject").alias("subject"), (F.col("m.n") / F.col("_all")).alias("share"))


def share_cutoff(shares: DataFrame, bounds: tuple[float, float] = SHARE, bins: int = 24) -> float:
    """The emptiest share between the stated bounds, over all documents; the middle if there are few in between."""
    low, high = bounds
    at = F.floor((F.col("share") - low) / (high - low) * bins).cast("int")
    inside = shares.where((F.col("share") > low) & (F.col("share") < high))
    counted = {r["b"]: r["n"] for r in inside.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = np.array([counted.get(i, 0) for i in range(bins)], float)
    wide = np.convolve(n, np.ones(5), "same")[2:-2]
    best = np.nonzero(wide <= wide.min() + 0.02 * n.sum())[0] + 2  # about equally empty ones: the one nearest to the middle
    middle = best[np.abs(best - (bins - 1) / 2).argmin()]
    return low + (middle + 0.5) * (high - low) / bins


def document_subjects(docs: DataFrame, model: Model, share: float | None = None, **columns: str) -> DataFrame:
    """``doc_id, subject`` of every subject that at least ``share`` of the sentences deal with; NULL: as calibrated."""
    shares = subject_shares(docs, model, **columns)
    share = share_cutoff(shares) if share is None else share
    return shares.where(F.col("share") >= share).select("doc_id", "subject")
