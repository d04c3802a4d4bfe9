"""N-gram Jaccard self-join by universe partition.

A text's set holds the hashes of its distinct word n-grams. Sets are cut into size bands, so that linked sets lie in
one band or in neighbouring ones. For a band, sets that link differ in at most H tokens. The token universe is hashed
into m segments; a segment has the allowance 0 (equal contents match) or 1 (contents that differ in one token match,
found by one-deletion neighbourhoods). If the allowances plus one sum up to H + 1, then one segment at least must
match, by the pigeonhole principle. z spare units pay for the segments left empty by a set: with at most z of them it does not
index them, and no link is lost. How many segments of each kind and how many spare units a band gets is chosen by
cost: keys written, and pairs that would meet by chance, given how many sets of the corpus are in the band.

Texts with one word sequence form a class, which is joined once. Sets that share a key meet their key's smallest class, the
center, first. A set's sketch has a bit for each of its hash buckets that holds an odd number of its tokens; two sketches differ in
at most as many bits as the sets differ in tokens, so sketches rule pairs out without loss and without the sets. What is left is
tested exactly, on the whole sets. After that, a center's classes that are still in different components meet in blocks, each two blocks in one
task, without writing their pairs: by sketches first, then, where some pair is left, by their sets. No candidate is dropped.

Defined cases: a null, empty or blank text has an empty set and links with nothing; a text of fewer words than n has its whole
sequence as its one n-gram; repeated rows are in one class, whatever their number; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm import bytewords
from plotweave.llm.common import bit_table, discard, fresh, perhaps_in, store
from plotweave.llm.components import connected_components

U = np.uint64
_FACTORS = bytewords.mix(np.arange(1, 65, dtype=np.uint64)) | U(1)
#: What it costs to compare a pair, in keys written.
PAIR_COST = 60.0
#: Classes that a task remembers, so as to write the keys of copies once.
SEEN = 1_000_000
#: Classes and bytes of tokens in a block of a center's (about, as they are dealt by hash), tokens in a slice of a cell, classes in a block of sketches.
BLOCK, BLOCK_BYTES, WIDTH, SKETCHES = 1_024, 8_000_000, 2_048, 4_096


@dataclass(frozen=True)
class Scheme:
    """Of a band: its smallest set, the most tokens by which linked sets differ, segments, how many of them allow one, spare units."""

    low: int
    differ: int
    segments: int
    ones: int
    spare: int


def band_lows(percent: int, largest: int) -> list[int]:
    """The smallest set size of each band, up to beyond largest: sets that link lie at most one band apart."""
    lows = [1, 2]
    while lows[-1] <= largest:
        lows.append(max(lows[-1] + 1, (lows[-1] - 1) * 100 // percent + 1))
    return lows


def allocate(low: int, high: int, percent: int, sets: int) -> Scheme:
    """The cheapest segments for sets of low to high tokens, of which the corpus has so many, and their larger partners."""
    # 100 * both >= percent * either, so the sizes' sum bounds the difference
    differ = (high + high * 100 // percent) * (100 - percent) // (100 + percent)
    best = None
    for spare in (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128):
        if spare > max(2, differ):
            break
        for share in (0.0, 0.1, 0.25, 0.5, 1.0):
            units = differ + 1 + spare
            ones = int(units * share / 2)
            segments = units - ones
            size = low / segments  # tokens in a segment, at least
            empty = math.exp(-size)
            zeros = segments - ones
            mean = zeros * empty
            term = tail = math.exp(-mean) if mean < 700 else 0.0
            for k in range(1, spare + 1):
                term *= mean / k
                tail += term
            kept = max(1.0 - tail, 0.0)  # sets with more empty segments than spare units
            keys = zeros + ones * (1 + high / segments)
            chance = zeros * (kept * empty) ** 2 + ones * (empty * (1 + size)) ** 2
            cost = sets * keys + PAIR_COST * sets * sets / 2 * chance
            if best is None or cost < best[0]:
                best = (cost, Scheme(low, differ, segments, ones, spare))
    return best[1]


@dataclass
class Sets:
    """The sets of a block: distinct tokens of text i, sorted, are tokens[at[i]:at[i + 1]]."""

    tokens: np.ndarray
    at: np.ndarray


def ngram_sets(w: bytewords.Words, n: int) -> Sets:
    counts = w.counts
    stop = np.repeat(w.at[1:], counts)
    places = np.arange(len(w.hashes))
    places = places[places + n <= stop]
    grams = np.zeros(len(places), dtype=np.uint64)
    for k in range(n):
        grams += w.hashes[places + k] * _FACTORS[k]
    texts = np.searchsorted(w.at, places, side="right") - 1
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.array([(w.hashes[w.at[i] : w.at[i + 1]] * _FACTORS[: counts[i]]).sum(dtype=np.uint64) for i in short.tolist()]) + _FACTORS[32 + counts[short]]
        grams, texts = np.concatenate([grams, whole]), np.concatenate([texts, short])
        order = np.argsort(texts, kind="stable")
        grams, texts = grams[order], texts[order]
    grams = bytewords.mix(grams)
    at = np.searchsorted(texts, np.arange(len(counts) + 1))
    for i in np.flatnonzero(np.diff(at) > 1).tolist():
        grams[at[i] : at[i + 1]].sort()
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (texts[1:] != texts[:-1])
    return Sets(grams[new], np.concatenate(([0], np.cumsum(new)))[at])


def sketches(s: Sets, rows: np.ndarray) -> list[bytes]:
    """The parity of the number of tokens in each hash bucket, for the sets of rows; a power of two of buckets, four for a token or more, 64 at least."""
    sizes = s.at[rows + 1] - s.at[rows]
    buckets = np.int64(64) << np.ceil(np.log2(np.maximum(sizes / 16, 1))).astype(np.int64)
    base = np.cumsum(buckets) - buckets
    own = np.repeat(np.arange(len(rows)), sizes)
    token = s.tokens[np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes - s.at[rows], sizes)]
    slot = base[own] + (token & (buckets[own] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.zeros(int(buckets.sum()) // 8, dtype=np.uint8)
    np.bitwise_xor.at(odd, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
    raw = odd.tobytes()
    return [raw[i // 8 : (i + n) // 8] for i, n in zip(base.tolist(), buckets.tolist(), strict=True)]


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch (or sketches, as rows) of the same sets with fewer buckets."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of tokens by which sets of these sketches differ; b may hold sketches as rows."""
    words = min(a.shape[-1], b.shape[-1])
    return np.bitwise_count(folded(a, words) ^ folded(b, words)).sum(axis=-1, dtype=np.int64)


def may_link(percent: int, differ, size_a, size_b):
    """Whether sets of these sizes that differ in so many tokens at least can link."""
    return ((100 + percent) * differ <= (100 - percent) * (size_a + size_b)) & (100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b))


def classes(w: bytewords.Words, salt: int) -> list[tuple[int, int] | None]:
    """Two 64-bit hashes of each word sequence; None without words."""
    key = salt.to_bytes(2, "little")
    out: list[tuple[int, int] | None] = []
    raw = w.hashes.tobytes()
    for a, b in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True):
        d = hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16, key=key).digest() if b > a else None
        out.append(d and (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
    return out


def keys(sets: Sets, rows: np.ndarray, schemes: list[Scheme], scheme_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which the sets of rows are indexed by schemes[scheme_of[i]], and the row of each key."""
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = np.array([s.segments for s in schemes], dtype=np.int64)[scheme_of]
    ones = np.array([s.ones for s in schemes], dtype=np.int64)[scheme_of]
    spare = np.array([s.spare for s in schemes], dtype=np.int64)[scheme_of]
    sizes = sets.at[rows + 1] - sets.at[rows]
    base = np.cumsum(m) - m
    own = np.repeat(np.arange(len(rows)), sizes)
    token = sets.tokens[np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes - sets.at[rows], sizes)]
    segment = ((token >> U(32)) * m[own].astype(np.uint64)) >> U(32)
    slot = base[own] + segment.astype(np.int64)
    value = bytewords.mix(token ^ _FACTORS[40])
    total = int(m.sum())
    low = np.bincount(slot, weights=(value & U(0xFFFFFFFF)).astype(np.float64), minlength=total).astype(np.uint64)
    high = np.bincount(slot, weights=(value >> U(32)).astype(np.float64), minlength=total).astype(np.uint64)
    content = low + (high << U(32))  # the sum of its tokens' values
    filled = np.bincount(slot, minlength=total)
    slot_row = np.repeat(np.arange(len(rows)), m)
    number = np.arange(total) - np.repeat(base, m)
    name = bytewords.mix(number.astype(np.uint64) * _FACTORS[41] + np.array([s.low for s in schemes], dtype=np.uint64)[scheme_of][slot_row])
    allows = number < ones[slot_row]
    hollow = (filled == 0) & ~allows
    empties = np.bincount(slot_row[hollow], minlength=len(rows))
    written = ~hollow | (empties > spare)[slot_row]
    out, whose = [bytewords.mix(content[written] + name[written])], [slot_row[written]]
    if ones.any():
        less = allows[slot]
        out.append(bytewords.mix(content[slot[less]] - value[less] + name[slot[less]]))
        whose.append(own[less])
    return np.concatenate(out), rows[np.concatenate(whose)]


def _texts(part: pa.RecordBatch, text: str) -> bytewords.Words:
    return bytewords.cut(part.column(part.schema.get_field_index(text)).to_pylist(), bytewords.WHITESPACE)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _unseen(classes: list[tuple[int, int] | None], seen: set[int]) -> np.ndarray:
    """The rows of classes that aren't among the seen ones, which they join while these are SEEN at most."""
    rows = []
    for i, x in enumerate(classes):
        if x is not None and x[0] not in seen:
            if len(seen) < SEEN:
                seen.add(x[0])
            rows.append(i)
    return np.array(rows, dtype=np.int64)


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """class, center of keys that several classes have; the rows come sorted by key and class. center: the key's smallest class."""
    last_key = last_class = center = None
    for batch in batches:
        k, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        new[0] = (last_key, last_class) != (k[0], c[0])
        k, c = k[new], c[new]
        if not len(k):
            continue
        first = np.ones(len(k), dtype=bool)
        first[1:] = k[1:] != k[:-1]
        first[0] = last_key is None or k[0] != last_key
        run = np.maximum.accumulate(np.where(first, np.arange(len(k)), -1))
        centers = np.where(run >= 0, c[np.maximum(run, 0)], center if center is not None else 0)
        later = ~first
        if later.any():
            pairs = np.unique(np.stack([c[later], centers[later]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0].copy()), pa.array(pairs[1].copy())], ["a", "b"])
        last_key, last_class, center = k[-1], c[-1], centers[-1]


def _cell_links(classes: np.ndarray, roots: np.ndarray, lists: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the roots of a cell's sets: each class that links to another root's, with one that stands for what it joins."""
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    flat, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), sizes)
    tokens, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.flatnonzero(counts > 1)
    place = np.full(len(tokens), -1, dtype=np.int64)
    place[common] = np.arange(len(common))
    column = place[inverse]
    both = np.zeros((len(lists), len(lists)), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, len(common), WIDTH):  # tokens in slices, so that memory is bounded by the cell
        i, j = np.searchsorted(column, (low, low + WIDTH))
        x = np.zeros((len(lists), WIDTH), dtype=np.float32)
        x[owner[i:j], column[i:j] - low] = 1
        both += x @ x.T
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    linked &= roots[:, None] != roots[None, :]
    parent = {r: r for r in roots.tolist()}

    def find(r):
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
        u, v = find(int(roots[i])), find(int(roots[j]))
        if u != v:
            parent[max(u, v)] = min(u, v)
            out.append((int(classes[i]), int(classes[j])))
    return out


def _sketch_cell(classes: np.ndarray, roots: np.ndarray, sizes: np.ndarray, held: list[np.ndarray], percent: int) -> np.ndarray:
    """The classes of a cell that may link to one of another root, as far as sketches tell."""
    open_ = np.zeros(len(classes), dtype=bool)
    lengths = np.array([len(x) for x in held])
    for length in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == length)
        near = np.flatnonzero((lengths >= length) & (lengths * percent <= length * 200))  # lengths are at most twice as far apart as sizes
        near = near[np.argsort(sizes[near], kind="stable")]
        table, near_sizes = np.stack([folded(held[k], length) for k in near.tolist()]), sizes[near]
        low = np.searchsorted(near_sizes, -(-percent * sizes[mine] // 100), side="left")
        high = np.searchsorted(near_sizes, sizes[mine] * 100 // percent, side="right")
        for i, a, b in zip(mine.tolist(), low.tolist(), high.tolist(), strict=True):
            others = near[a:b]
            apart = roots[others] != roots[i]
            if apart.any():
                others = others[apart]
                ok = may_link(percent, differ(held[i], table[a:b][apart]), sizes[i], sizes[others])
                if ok.any():
                    open_[i] = True
                    open_[others[ok]] = True
    return classes[open_]


class Join:
    """The join of one table; see the module's text."""

    def __init__(self, docs: DataFrame, *, doc: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80):
        """percent: sets link when 100 * tokens in both >= percent * tokens in either."""
        self.docs, self.n, self.percent = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")), n, percent

    def members(self) -> DataFrame:
        """doc, size, class, sketch of each row; class is null for an empty set, sketch where a task has written the class's before.

        Another salt is taken until no two word sequences share a class.
        """
        n = self.n
        for salt in range(100):

            def run(batches, salt=salt):
                seen: set[int] = set()
                for part in bytewords.blocks(batches, "text"):
                    w = _texts(part, "text")
                    s, c = ngram_sets(w, n), classes(w, salt)
                    new = _unseen(c, seen)
                    sketch: list[bytes | None] = [None] * len(c)
                    for i, x in zip(new.tolist(), sketches(s, new), strict=True):
                        sketch[i] = x
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(np.diff(s.at)), pa.array([x and x[0] for x in c], pa.int64()), pa.array([x and x[1] for x in c], pa.int64()), pa.array(sketch, pa.binary())],
                        ["doc", "size", "class", "check", "sketch"],
                    )

            kind = self.docs.schema["doc"].dataType.simpleString()
            found = store(self.docs.mapInArrow(run, f"doc {kind}, size long, class long, check long, sketch binary"), "members")
            by_class = found.filter("class is not null").groupBy("class")
            if by_class.agg((F.min("check") != F.max("check")).alias("bad")).filter("bad").isEmpty():
                self.salt = salt
                return found
            discard(found)
        raise RuntimeError("no salt keeps the classes apart")

    def schemes(self, members: DataFrame) -> list[Scheme]:
        """One for each band that the corpus has, from the numbers of classes by size over all rows."""
        largest = members.agg(F.max("size")).first()[0] or 0
        lows = band_lows(self.percent, largest)
        edges = F.array(*map(F.lit, lows))
        band = F.size(F.filter(edges, lambda e: e <= F.col("size"))) - 1
        classes = members.filter("class is not null").groupBy("class").agg(F.first("size").alias("size"))
        held = dict(classes.groupBy(band.alias("band")).count().collect())  # as many rows as bands
        return [allocate(lows[k], lows[k + 1] - 1, self.percent, held.get(k, 0) + held.get(k + 1, 0) + 1) for k in range(len(lows) - 1)]

    def index(self, schemes: list[Scheme]) -> DataFrame:
        """a, b: each class with the centers (smallest classes) of the keys that it shares."""
        n, salt = self.n, self.salt
        lows = np.array([s.low for s in schemes], dtype=np.int64)

        def run(batches):
            seen: set[int] = set()
            for part in bytewords.blocks(batches, "text"):
                w = _texts(part, "text")
                s, c = ngram_sets(w, n), classes(w, salt)
                rows = _unseen(c, seen)
                if not len(rows):
                    continue
                own = np.array([x[0] if x else 0 for x in c], dtype=np.int64)
                band = np.searchsorted(lows, np.diff(s.at)[rows], side="right") - 1
                below = band > 0
                k, whose = keys(s, np.concatenate([rows, rows[below]]), schemes, np.concatenate([band, band[below] - 1]))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(k)), pa.array(own[whose])], ["key", "class"])

        if not schemes:
            return self.docs.sparkSession.createDataFrame([], "a long, b long")
        written = self.docs.mapInArrow(run, "key long, class long")
        return store(written.repartition("key").sortWithinPartitions("key", "class").mapInArrow(meetings, "a long, b long").distinct(), "meetings")

    def sketched(self, stars: DataFrame, members: DataFrame) -> DataFrame:
        """class, size, sketch of the classes of stars."""
        needed = stars.select(F.col("a").alias("class")).union(stars.select("b")).distinct()
        first = members.filter("sketch is not null").select("class", "size", "sketch").join(needed, "class", "left_semi")
        return store(first.groupBy("class").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch")), "sketches")

    def near(self, pairs: DataFrame, sketched: DataFrame) -> DataFrame:
        """The pairs of classes (a, b) that may link, as far as their sketches tell."""
        percent = self.percent
        both = pairs.select("a", "b").join(sketched.toDF("b", "size_b", "sketch_b"), "b").join(sketched.toDF("a", "size_a", "sketch_a"), "a")

        def run(batches):
            for batch in batches:
                left, right = batch.column(4), batch.column(5)
                least = [differ(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) for x, y in zip(left, right, strict=True)]
                ok = may_link(percent, np.array(least, dtype=np.int64), batch.column(2).to_numpy(), batch.column(3).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in (0, 1)], ["a", "b"])

        return store(both.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long"), "near")

    def sets(self, needed: DataFrame, members: DataFrame) -> DataFrame:
        """class, tokens (64-bit numbers, sorted, as bytes) of the needed classes, from one text of each."""
        n, salt = self.n, self.salt
        one = members.filter("class is not null").select("doc", "class").join(needed, "class", "left_semi").groupBy("class").agg(F.min("doc").alias("doc"))
        # ids meet by a short hash, whatever their type; of the rows that share it, those of the class are taken below
        picked = store(one.select(F.when(F.col("doc").isNotNull(), F.xxhash64("doc")).alias("id"), "class"), "picked")

        def named(batches):
            seen: set[int] = set()
            for part in bytewords.blocks(batches, "text"):
                c = classes(_texts(part, "text"), salt)
                first = _unseen(c, seen).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([c[i][0] for i in first], pa.int64()), part.column(part.schema.get_field_index("text")).take(pa.array(first, pa.int64()))], ["class", "text"])

        def run(batches):
            for part in bytewords.blocks(batches, "text"):
                w = _texts(part, "text")
                s = ngram_sets(w, n)
                raw, own = s.tokens.tobytes(), [x and x[0] for x in classes(w, salt)]
                right = [i for i, (x, y) in enumerate(zip(own, part.column(0).to_pylist(), strict=True)) if x == y]  # an id may have several texts
                yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in right], pa.int64()), pa.array([raw[8 * s.at[i] : 8 * s.at[i + 1]] for i in right], pa.binary())], ["class", "tokens"])

        # texts whose id isn't in the bit table stay where they are
        held, flag = perhaps_in(self.docs.filter("doc is not null").select(F.xxhash64("doc").alias("id"), "text"), F.col("id"), bit_table(picked.select("id")))
        texts = held.filter(flag).select("id", "text").join(picked, "id").select("class", "text")
        nameless = picked.filter("id is null").select("class")
        if not nameless.isEmpty():  # classes whose rows all have null ids
            texts = texts.union(self.docs.filter("doc is null").select("text").mapInArrow(named, "class long, text string").join(nameless, "class").select("class", "text"))
        found = store(texts.mapInArrow(run, "class long, tokens binary").groupBy("class").agg(F.first("tokens").alias("tokens")), "sets")
        discard(picked)
        return found

    def compare(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """a, b, shared, size_a, size_b of each pair of classes (a, b), from their whole sets."""
        both = pairs.join(sets.toDF("b", "tokens_b"), "b").join(sets.toDF("a", "tokens_a"), "a")

        def run(batches):
            for batch in batches:
                a, b, left, right = (batch.column(i) for i in range(4))
                shared, sizes = [], ([], [])
                for x, y in zip(left, right, strict=True):
                    x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                    sizes[0].append(len(x))
                    sizes[1].append(len(y))
                    x, y = (x, y) if len(x) < len(y) else (y, x)
                    shared.append(int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0)
                yield pa.RecordBatch.from_arrays([a, b, *(pa.array(v, pa.int64()) for v in (shared, *sizes))], ["a", "b", "shared", "size_a", "size_b"])

        return store(both.select("a", "b", "tokens_a", "tokens_b").mapInArrow(run, "a long, b long, shared long, size_a long, size_b long"), "compared")

    def linked(self, compared: DataFrame) -> DataFrame:
        return compared.filter(100 * F.col("shared") >= self.percent * (F.col("size_a") + F.col("size_b") - F.col("shared"))).select("a", "b")

    def components(self) -> tuple[DataFrame, DataFrame]:
        """members, and node (class), root of all classes that have links."""
        members = self.members()
        stars = self.index(self.schemes(members))
        sketched = self.sketched(stars, members)
        found = connected_components(self.links(self.near(stars, sketched), members))
        open_ = self.rest(stars, found, sketched)
        discard(stars, sketched)
        links = self.cell_links(open_, members)
        if not links.isEmpty():
            first, found = found, connected_components(links.union(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
            discard(first)
        discard(links)
        return members.select("doc", "size", "class"), found

    def links(self, pairs: DataFrame, members: DataFrame) -> DataFrame:
        """The pairs of classes (a, b) that link, from their whole sets. pairs are discarded."""
        sets = self.sets(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct(), members)
        compared = self.compare(pairs, sets)
        discard(pairs, sets)
        found = store(self.linked(compared), "links")
        discard(compared)
        return found

    def rest(self, stars: DataFrame, found: DataFrame, sketched: DataFrame) -> DataFrame:
        """class, center, root of the classes that may link to one of their center's that is in another component, as far as sketches tell.

        Sets that share a key have met its center, so all pairs to test lie among the classes of one center.
        """
        around = stars.join(found.withColumnRenamed("node", "a"), "a", "left").select(F.col("a").alias("class"), F.col("b").alias("center"), F.coalesce("root", "a").alias("root"))
        around = self.open_groups(around)
        percent = self.percent

        def run(batches):
            for (center, _, _), rows in _cells(batches):
                kept = _sketch_cell(*(np.array(x) for x in rows[:3]), [np.frombuffer(x, "<u8") for x in rows[3]], percent) if len(rows[0]) > 1 else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), center)), pa.array(kept)], ["center", "class"])

        sized = around.join(sketched, "class")
        cells = _dealt(sized, F.count("*") / SKETCHES, F.sum(F.length("sketch")) / BLOCK_BYTES).select(*_CELL, "class", "root", "size", "sketch")
        some = store(_by_cell(cells).mapInArrow(run, "center long, class long").distinct(), "some")
        left = self.open_groups(around.join(some, ["center", "class"]))
        discard(around, some)
        return left

    def cell_links(self, around: DataFrame, members: DataFrame) -> DataFrame:
        """Links between classes of one center that are in different components; each two blocks of a center's classes are one cell, that a task tests as a whole."""
        sets, percent = self.sets(around.select("class").distinct(), members), self.percent

        def run(batches):
            for _, (c, roots, tokens) in _cells(batches):
                found = _cell_links(np.array(c), np.array(roots), [np.frombuffer(x, dtype=np.uint64) for x in tokens], percent) if len(c) > 1 else []
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        dealt = _dealt(around.join(sets.select("class", F.length("tokens").alias("bytes")), "class"), F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)
        cells = dealt.select(*_CELL, "class", "root").join(sets, "class").select(*_CELL, "class", "root", "tokens")
        links = store(_by_cell(cells).mapInArrow(run, "a long, b long").distinct(), "links")
        discard(around, sets)
        return links

    def open_groups(self, around: DataFrame) -> DataFrame:
        """Rows of centers whose classes are in several components."""
        several = store(around.groupBy("center").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("center"), "several")
        found = store(around.join(several.hint("merge"), "center"), "around")  # two plain tables: Spark splits the side where a center has many rows
        discard(several)
        return found


#: A cell: two blocks of a center's classes.
_CELL = ("center", "low", "high")


def _dealt(around: DataFrame, *blocks) -> DataFrame:
    """around with each row once for each cell that its class is in. blocks: how many blocks a center's rows make, at least.

    The counts are written first, so that the rows meet them by a plain merge join, whose sides Spark splits where a center has many rows.
    """
    counts = store(around.groupBy("center").agg(F.ceil(F.greatest(*blocks, F.lit(1.0))).alias("blocks")), "counts")
    dealt = around.join(counts.hint("merge"), "center").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})


def _by_cell(cells: DataFrame) -> DataFrame:
    return cells.repartition(*_CELL).sortWithinPartitions(*_CELL)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[list]]]:
    """Each cell's name and the columns behind it, of rows sorted by cell."""
    cell, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if row[:3] != cell:
                if held:
                    yield cell, list(zip(*held, strict=True))
                cell, held = row[:3], []
            held.append(row[3:])
    if held:
        yield cell, list(zip(*held, strict=True))


def groups(docs: DataFrame, *, doc: str = "doc_id", **options) -> DataFrame:
    """doc, n_shingles, component (the smallest doc that is reachable by links, itself included) of each row.

    A null doc has the component of its set's other rows, or null.
    """
    members, found = Join(docs, doc=doc, **options).components()
    smallest = members.filter("class is not null").groupBy("class").agg(F.min("doc").alias("low"))
    of_root = smallest.join(found, smallest["class"] == found["node"]).groupBy("root").agg(F.min("low").alias("root_low"))
    of_class = smallest.join(found, smallest["class"] == found["node"], "left").join(of_root, "root", "left").select("class", F.coalesce("root_low", "low").alias("component"))
    return members.join(of_class, "class", "left").select("doc", F.col("size").alias("n_shingles"), F.coalesce("component", "doc").alias("component"))


def keep_one(docs: DataFrame, *, doc: str = "doc_id", **options) -> DataFrame:
    """docs with exactly one row of each group: of those with the smallest id (null ids come last), the one with the lowest hash of its columns.

    Rows with one id are apart where their texts are in different groups; repeated rows are copies. Rows with an empty set link with nothing and stay.
    """
    one, two = fresh(docs, "row_hash_one"), fresh(docs, "row_hash_two")
    plain = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString() and docs.schema[c].dataType.simpleString() != "variant"]
    tagged = docs.withColumns({one: F.xxhash64(*plain), two: F.xxhash64(F.lit(1), *plain)})
    row = F.struct(F.col(doc).isNull().alias("nameless"), F.col(doc).alias("doc"), F.col(one).alias("one"), F.col(two).alias("two"))
    name = fresh(tagged, "row")
    members, found = Join(tagged.withColumn(name, row), doc=name, **options).components()
    rows = members.join(found.withColumnRenamed("node", "class"), "class", "left").select(F.coalesce("root", "class").alias("group"), F.col("doc").alias("row"))
    rows = rows.groupBy("group", "row").agg(F.count("*").alias("n"))  # so that copies don't meet in one task
    best = rows.filter("group is not null").groupBy("group").agg(F.min("row").alias("best"), F.count("*").alias("of"))
    # rows that aren't alone in their group; all others stay without a shuffle of their texts
    shared = rows.filter("group is not null").join(best.filter("of > 1"), "group").select("row", F.when(F.col("row") == F.col("best"), F.col("n")).otherwise(0).alias("n"))
    alone = rows.filter("group is not null and n > 1").join(best.filter("of = 1"), "group").select("row", "n")
    shared = store(shared.union(alone).union(rows.filter("group is null and n > 1").select("row", "n")).select("row.doc", "row.one", "row.two", "n"), "shared")
    flagged, flag = perhaps_in(tagged, F.col(one), bit_table(shared.select(F.col("one").alias("id"))))

    def rows_of(some: DataFrame, how: str) -> DataFrame:
        some = some.select(*(F.col(c).alias(f"kept {c}") for c in ("doc", "one", "two")))
        same = flagged[doc].eqNullSafe(some["kept doc"]) & (flagged[one] == some["kept one"]) & (flagged[two] == some["kept two"])
        return flagged.filter(flag).join(some, same, how)

    kept = flagged.filter(~F.col(flag)).union(rows_of(shared, "left_anti")).union(rows_of(shared.filter("n = 1"), "left_semi"))
    repeated = shared.filter("n > 1")
    if not repeated.isEmpty():
        kept = kept.union(rows_of(repeated, "left_semi").dropDuplicates([doc, one, two]))
    return kept.select(*docs.columns)
