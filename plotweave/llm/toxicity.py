"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities and rates over all of it: words and word beginnings of a lexicon, how near the
second person stands to them, capitals, punctuation, marks of obfuscation, and lexicon words that appear once
digits and symbols are read as letters. The lexicon is learned: words, and first four or five bytes of words, that
labelled toxic texts have and others don't, besides a short list of common insults. Scores depend on the text alone.

Lexicon, trees and calibration are fitted on a bounded sample of labelled rows (SAMPLE of each label, by hash): one part of it grows
the trees, another, unseen by them, calibrates. A labelled text's own words don't count for it while it trains.
All rows are scored in one pass, without a shuffle.

Defined cases: a null text is an empty one; an empty text has a score too; labels that are null are left out, and a document with several
labels has the largest; without labels of both kinds every score is the share of toxic labels, or 0 without any; repeated rows
have equal scores; columns of other names pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotweave.llm import bytewords
from plotweave.llm.common import annotate, remainder, store

#: Labelled rows of each label that the sample has at most.
SAMPLE = 20_000
#: Entries of the lexicon; toxic texts that must have an entry; its least log odds, less so many standard errors.
LEXICON, SUPPORT, ODDS, DOUBT = 4_000, 3, 1.0, 1.2
#: Trees, their depth, the step, the least rows of a leaf, and the bins of a feature.
TREES, DEPTH, RATE, LEAF, BINS = 120, 3, 0.15, 5, 48
#: A text is toxic from this score on.
THRESHOLD = 0.3

#: Common English insults, and words for the second person in four languages.
INSULTS = ("idiot", "moron", "loser", "scum", "pathetic", "worthless", "trash", "clown", "disgusting", "stupid", "dumb", "fool", "jerk", "filth", "garbage", "vermin")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "tu", "te", "toi", "ton", "ta", "vous", "votre", "ti", "usted", "vosotros", "su")
#: What obfuscated letters are read as.
READ_AS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

FEATURES = (
    "words", "entry_density", "entries", "distinct_entries", "weight_density", "largest_weight", "insult_density", "second_person_density", "near_second_person",
    "capitals", "punctuation", "exclamations", "digits", "mixed_words", "symbol_runs", "beyond_ascii", "hidden_density", "weight_sum",
)
_READ = bytes(ord(READ_AS[chr(b)]) if chr(b) in READ_AS else b for b in range(256))
_PUNCT = np.array([chr(b) in "!\"'(),-.:;?[]" for b in range(256)])
_SYMBOL = np.array([chr(b) in "#$%&*@^~_=+" for b in range(128)] + [False] * 128)


def _hashes(words: tuple[str, ...]) -> np.ndarray:
    return np.unique(bytewords.cut(list(words), bytewords.ALNUM).hashes)


def _member(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in ordered, and where."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=np.int64)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values, at


def entries(w: bytewords.Words) -> list[np.ndarray]:
    """Hashes of each word and of its first four and five bytes (0 where it has no more of them)."""
    eights = np.ndarray((len(w.buffer) - 8,), dtype="<u8", buffer=w.buffer, strides=(1,))
    start = eights[w.starts] if len(w.starts) else np.zeros(0, np.uint64)
    out, lengths = [w.hashes], w.ends - w.starts
    for n in (4, 5):
        h = bytewords.mix((start & np.uint64((1 << (8 * n)) - 1)) * np.uint64(2 * n + 1) + np.uint64(n))
        out.append(np.where(lengths > n, h, 0).astype(np.uint64))
    return out


@dataclass
class Lexicon:
    """Sorted entries, in how many toxic and other texts of the sample each is, and how many of these texts there are."""

    entry: np.ndarray
    toxic: np.ndarray
    other: np.ndarray
    texts: tuple[int, int]

    def weights(self, label: int | None) -> np.ndarray:
        """Log odds of each entry less DOUBT standard errors, for a text of that label as if it weren't in the sample; 0 below the thresholds."""
        toxic, other = self.toxic - (label == 1), self.other - (label == 0)
        n, m = self.texts[0] - (label == 1), self.texts[1] - (label == 0)
        odds = np.log((np.maximum(toxic, 0) + 0.5) / (n + 1)) - np.log((np.maximum(other, 0) + 0.5) / (m + 1))
        sure = odds - DOUBT * np.sqrt(1 / (np.maximum(toxic, 0) + 0.5) + 1 / (np.maximum(other, 0) + 0.5))
        return np.where((toxic >= SUPPORT) & (sure >= ODDS), sure, 0.0)


def features(texts: list, lexicon: Lexicon, labels: list | None = None) -> np.ndarray:
    """A row of FEATURES for each text. labels: of texts that are in the sample."""
    w = bytewords.cut(texts, bytewords.ALNUM)
    size, counts = len(texts), w.counts
    owner = np.repeat(np.arange(size), counts)
    n = np.maximum(counts, 1)
    per = lambda v, owner=owner: np.bincount(owner, weights=v, minlength=size)
    weight = np.zeros(len(w.hashes))
    own = {y: lexicon.weights(y) for y in (None, 0, 1)}
    label = np.array([-1 if y is None else y for y in labels])[owner] if labels is not None else None
    for found in entries(w):
        there, at = _member(found, lexicon.entry)
        if there.any():
            if label is None:
                value = np.where(there, own[None][at], 0.0)
            else:
                value = np.where(there, np.where(label == 1, own[1][at], np.where(label == 0, own[0][at], own[None][at])), 0.0)
            weight = np.maximum(weight, value)
    insult, _ = _member(w.hashes, _hashes(INSULTS))
    person, _ = _member(w.hashes, _hashes(SECOND_PERSON))
    hit = (weight > 0) | insult
    distinct = np.zeros(size)
    if hit.any():
        pairs = np.unique(np.stack([owner[hit].astype(np.uint64), w.hashes[hit]]), axis=1)
        distinct = np.bincount(pairs[0].astype(np.int64), minlength=size).astype(float)
    places = np.flatnonzero(person)
    near = np.zeros(len(w.hashes))
    if len(places) and hit.any():
        at = np.flatnonzero(hit)
        i = np.searchsorted(places, at)
        for j in (np.minimum(i, len(places) - 1), np.maximum(i - 1, 0)):
            far = np.abs(places[j] - at)
            near[at] = np.maximum(near[at], np.where((owner[places[j]] == owner[at]) & (far <= 20), 1 / (1 + far), 0.0))
    # rates over bytes
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = b" ".join(parts) + b" "
    data = np.frombuffer(raw, dtype=np.uint8)
    begin = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))[:-1]
    length = np.array([max(len(p), 1) for p in parts])
    rate = lambda mask: np.add.reduceat(mask.astype(np.int64), begin) / length if size else np.zeros(0)
    symbol = _SYMBOL[data]
    run = np.zeros(len(data), dtype=bool)
    run[2:] = symbol[2:] & symbol[1:-1] & symbol[:-2]
    digit, letter = (data >= 48) & (data <= 57), ((data | 32) >= 97) & ((data | 32) <= 122)
    joint = np.zeros(len(data), dtype=bool)
    joint[1:] = (digit[1:] & letter[:-1]) | (letter[1:] & digit[:-1])
    # lexicon words that show once symbols are read as letters
    hidden = np.zeros(size)
    if (suspect := np.flatnonzero(rate(joint | symbol | (data == 33)) > 0)).size:
        read = bytewords.cut([parts[i].translate(_READ).decode("utf-8", "replace") for i in suspect.tolist()], bytewords.ALNUM)
        there, at = _member(read.hashes, lexicon.entry)
        shown = (there & (own[None][at] > 0) if len(lexicon.entry) else there) | _member(read.hashes, _hashes(INSULTS))[0]
        total = np.bincount(np.repeat(np.arange(len(suspect)), read.counts), weights=shown, minlength=len(suspect))
        hidden[suspect] = np.maximum(total - per(hit.astype(float))[suspect], 0)
    largest = np.zeros(size)
    np.maximum.at(largest, owner, weight)
    hits = per(hit.astype(float))
    return np.column_stack([
        np.log1p(counts), hits / n, np.log1p(hits), np.log1p(distinct), per(weight) / n, largest, per(insult.astype(float)) / n, per(person.astype(float)) / n, per(near) / n,
        rate((data >= 65) & (data <= 90)), rate(_PUNCT[data]), rate(data == 33), rate(digit), rate(joint), rate(run), rate(data >= 128), hidden / n, np.log1p(per(weight)),
    ])


@dataclass
class Trees:
    """Trees of one depth: feature and limit of each inner node by level, and the leaves' values; then the calibration's steps."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    base: float
    at: np.ndarray
    share: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, with a trace of the margin, so that texts of one step keep their order."""
        if not len(self.leaf):
            return np.full(len(x), self.share[0])
        m = self.margin(x)
        raw = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        share = np.interp(m, self.at, self.share) if len(self.at) else raw
        return np.clip(0.999 * share + 0.001 * raw, 0.0, 1.0)


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees with logistic loss, by histograms of each feature's quantiles."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
    base = float(np.log(rate / (1 - rate)))
    margin, inner = np.full(len(y), base), 2**DEPTH - 1
    trees = ([], [], [])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, limit, node = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(len(y), dtype=np.int64)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            best = 1e-6
            if len(own) >= 2 * LEAF:
                total = g[own].sum() ** 2 / (h[own].sum() + 1)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[own, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, weights=v, minlength=len(c) + 1))[:-1] for v in (g[own], h[own], np.ones(len(own))))
                    gr, hr = g[own].sum() - gl, h[own].sum() - hl
                    gain = np.where((nl >= LEAF) & (len(own) - nl >= LEAF), gl**2 / (hl + 1) + gr**2 / (hr + 1) - total, -1.0)
                    if gain.max() > best:
                        best, feature[k], limit[k] = float(gain.max()), j, c[int(gain.argmax())]
            node[own] = 2 * k + 1 + (x[own, feature[k]] > limit[k])
        leaf = np.zeros(2**DEPTH)
        for k in range(2**DEPTH):
            own = node == inner + k
            leaf[k] = -RATE * g[own].sum() / (h[own].sum() + 1)
        margin += leaf[node - inner]
        for t, v in zip(trees, (feature, limit, leaf), strict=True):
            t.append(v)
    return Trees(np.array(trees[0]), np.array(trees[1]), np.array(trees[2]), base, np.zeros(0), np.zeros(0))


def isotonic(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing steps nearest to y over m, by pooling adjacent violators: place and share of each."""
    order = np.argsort(m, kind="stable")
    pools: list[list[float]] = []  # sum of y, rows, sum of m
    for a, b in zip(m[order].tolist(), y[order].tolist(), strict=True):
        pools.append([b, 1.0, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + 0.02) / (p[1] + 0.04) if p[1] > 1 else p[0] / p[1] for p in pools])


def fit(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[Lexicon, Trees]:
    """Lexicon and trees from the sample of labelled rows that the held-out remainder doesn't hold."""
    spark = docs.sparkSession
    known = labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull() & ~held_out(doc)).groupBy(F.col(doc).alias("doc")).agg((F.max(label) > 0).cast("int").alias("label"))
    ids = known.filter("label = 1").orderBy(F.xxhash64("doc")).limit(SAMPLE).union(known.filter("label = 0").orderBy(F.xxhash64("doc")).limit(SAMPLE))
    sample = store(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).join(F.broadcast(ids), "doc").select("doc", "text", "label", (remainder("doc", 4) == 3).cast("int").alias("calibrates")), "labelled")
    texts = dict(sample.groupBy("label").count().collect())

    def count(batches):
        for part in bytewords.blocks(batches, "text", 4_000_000):
            label = part.column(2).to_numpy()
            w = bytewords.cut(part.column(1).to_pylist(), bytewords.ALNUM)
            owner = np.repeat(np.arange(len(label)), w.counts).astype(np.uint64)
            found = np.concatenate([np.stack([e, owner]) for e in entries(w)], axis=1)
            found = np.unique(found[:, found[0] != 0], axis=1)
            types, inverse = np.unique(found[0], return_inverse=True)
            toxic = np.bincount(inverse, weights=label[found[1].astype(np.int64)], minlength=len(types)).astype(np.int64)
            both = np.bincount(inverse, minlength=len(types)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(types.view(np.int64)), pa.array(toxic), pa.array(both - toxic)], ["entry", "toxic", "other"])

    n, m = texts.get(1, 0), texts.get(0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (n + 1)) - F.log((F.col("other") + 0.5) / (m + 1))
    odds = odds - DOUBT * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    counted = sample.mapInArrow(count, "entry long, toxic long, other long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    top = counted.filter((F.col("toxic") >= SUPPORT) & (odds >= ODDS)).orderBy(odds.desc(), "entry").limit(LEXICON).toArrow().to_pandas()
    entry = top["entry"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(entry)
    lexicon = Lexicon(entry[order], top["toxic"].to_numpy().astype(np.int64)[order], top["other"].to_numpy().astype(np.int64)[order], (n, m))
    shared = spark.sparkContext.broadcast(lexicon)

    def measure(batches):
        for part in bytewords.blocks(batches, "text", 2_000_000):
            label = part.column(2).to_pylist()
            x = features(part.column(1).to_pylist(), shared.value, label)
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), *(pa.array(x[:, j].copy()) for j in range(x.shape[1]))], ["label", "calibrates", *FEATURES])

    rows = sample.mapInArrow(measure, "label int, calibrates int, " + ", ".join(f"{f} double" for f in FEATURES)).toArrow().to_pandas()  # at most 2 * SAMPLE rows of numbers
    rows = rows.sort_values([*FEATURES, "label"], kind="stable")
    y, x, later = rows["label"].to_numpy().astype(float), rows[list(FEATURES)].to_numpy(), rows["calibrates"].to_numpy() == 1
    if not 0 < y[~later].sum() < (~later).sum():
        share = float(y.mean()) if len(y) else 0.0
        none = np.zeros((0, 2**DEPTH - 1))
        return lexicon, Trees(none.astype(np.int64), none, np.zeros((0, 2**DEPTH)), 0.0, np.array([0.0]), np.array([share]))
    trees = grow(x[~later], y[~later])
    if 0 < y[later].sum() < later.sum():
        trees.at, trees.share = isotonic(trees.margin(x[later]), y[later])
    return lexicon, trees


def held_out(doc: str = "doc_id") -> Column:
    return remainder(doc, 4) == 2


def score(docs: DataFrame, model: tuple[Lexicon, Trees], *, text: str = "text") -> tuple[DataFrame, str]:
    """docs with a column of scores, and its name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        lexicon, trees = shared.value
        for part in bytewords.blocks(batches, text, 1_000_000):
            yield part, pa.array(trees.score(features(part.column(part.schema.get_field_index(text)).to_pylist(), lexicon)))

    return annotate(docs, [text], "toxicity", T.DoubleType(), work)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found, name = score(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), F.col(name).alias("score"), (F.col(name) >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """docs whose score is below the threshold."""
    found, name = score(docs, fit(docs, labels, text=text, **options), text=text)
    return found.filter(F.col(name) < THRESHOLD).drop(name)
