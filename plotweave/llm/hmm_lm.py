"""Language-model scoring with a hidden Markov model.

Symbols are the most frequent tokens of the training rows, classes of all other tokens by their last bytes, and the end. A token outside
the symbols has the probability of its class in a state times its share of the class, which its training count gives. In each class the mass
of one unseen token is kept back, which every unseen token of the class gets: one probability for each, not shared among them.

Training counts every token of every training row (a shuffle that grows with the corpus), then runs Baum-Welch: each task
adds up the expected counts of its partition by scaled forward and backward recursion, Spark sums them, and the driver, which
holds states x symbols numbers whatever the corpus, updates the model. It starts from clusters: centers from SEED_TEXTS distinct texts, chosen by
hash, then one pass in which every text of the corpus adds its counts to its nearest center. Long texts are cut into chunks for training only.
Scoring is the exact scaled forward recursion over each whole text.

The counts of the most frequent tokens are broadcast, a fixed number of them; those of all others are joined.

Tokens are known by 64-bit hashes. Defined cases: a null or blank text is the end alone; repeated rows are scored one by one;
without training rows, every token is unknown; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotweave.llm import bytewords
from plotweave.llm.common import fresh, remainder, store

#: Latent states, rounds of Baum-Welch, frequent tokens with symbols of their own, classes of the others.
STATES, ROUNDS, FREQUENT, CLASSES = 8, 4, 15_000, 1_024
#: Frequent tokens whose counts are broadcast.
KNOWN = 262_144
#: Tokens in a chunk of training; texts that the first centers are made from; weight of the corpus in a state's probabilities.
CHUNK, SEED_TEXTS, PRIOR = 128, 2_000, 200.0
#: Bytes of text in a block; token types that a task adds up before it writes them.
BLOCK, HELD = 8_000_000, 2_000_000
#: The end counts as a token of this hash.
END = 0
LOW = 0.1


def token_classes(w: bytewords.Words) -> np.ndarray:
    """The class of each word, from its last three bytes."""
    data = np.frombuffer(w.buffer, dtype=np.uint8)
    code = np.zeros(len(w.starts), dtype=np.uint64)
    for back in (1, 2, 3):
        at = w.ends - back
        code = code * np.uint64(256) + np.where(at >= w.starts, data[np.maximum(at, 0)], 0).astype(np.uint64)
    return (bytewords.mix(code + np.uint64(1)) % np.uint64(CLASSES)).astype(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def token_counts(train: DataFrame) -> DataFrame:
    """token, class, c of all tokens of the rows, without the end."""

    def rows(found: list) -> pa.RecordBatch:
        h, k, n = (np.concatenate(x) for x in zip(*found, strict=True))
        types, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        counts = np.bincount(inverse, weights=n).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(_signed(types)), pa.array(k[first]), pa.array(counts)], ["token", "class", "c"])

    def run(batches):
        found, held = [], 0
        for part in bytewords.blocks(batches, "text", BLOCK):
            w = bytewords.cut(part.column(0).to_pylist(), bytewords.WHITESPACE)
            types, first, counts = np.unique(w.hashes, return_index=True, return_counts=True)
            found.append((types, token_classes(w)[first], counts))
            held += len(types)
            if held > HELD:
                yield rows(found)
                found, held = [], 0
        if found:
            yield rows(found)

    return train.select("text").mapInArrow(run, "token long, class long, c long").groupBy("token", "class").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What every task knows of the training rows; of fixed size."""

    known: np.ndarray  # sorted hashes of the most frequent tokens
    counts: np.ndarray  # their counts
    symbol: np.ndarray  # their symbols, or -1
    class_total: np.ndarray  # counts of the tokens of each class that have no symbol, with what unseen ones get
    shares: np.ndarray  # probability of each symbol in the corpus
    tokens: int  # all training tokens, ends counted
    types: int  # distinct training tokens, the end counted
    ends: int

    @property
    def end(self) -> int:
        return len(self.shares) - 1

    def look_up(self, w: bytewords.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word: its count or -1 where it must be joined, its symbol, and its class or -1 where it has a symbol of its own."""
        at = np.minimum(np.searchsorted(self.known, w.hashes), max(len(self.known) - 1, 0))
        there = self.known[at] == w.hashes if len(self.known) else np.zeros(len(w.hashes), dtype=bool)
        count = np.where(there, self.counts[at], -1) if len(self.known) else np.full(len(w.hashes), -1)
        own = np.where(there, self.symbol[at], -1) if len(self.known) else np.full(len(w.hashes), -1)
        kind = token_classes(w)
        return count, np.where(own >= 0, own, self.end - CLASSES + kind), np.where(own >= 0, -1, kind)


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    # the most frequent tokens by steps of their counts, as many steps as fit: no task sends more than its share of them
    step = F.floor(F.log2("c") * 64)
    room, least = KNOWN, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    top = counts.filter(step >= least) if least is not None else counts.limit(0)
    top = top.toArrow().to_pandas().sort_values(["c", "token"], ascending=[False, True])  # KNOWN rows at most
    by_class = {r["class"]: (r["n"], r["types"]) for r in counts.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("types")).collect()}
    total, types = sum(n for n, _ in by_class.values()), sum(t for _, t in by_class.values())
    order = np.argsort(top["token"].to_numpy().astype(np.int64).view(np.uint64), kind="stable")
    rank = np.arange(len(top))[order]
    frequent = min(FREQUENT, len(top))
    class_count = np.array([by_class.get(k, (0, 0)) for k in range(CLASSES)], dtype=np.float64).reshape(CLASSES, 2)
    np.subtract.at(class_count[:, 0], top["class"].to_numpy()[:frequent].astype(np.int64), top["c"].to_numpy()[:frequent])
    np.subtract.at(class_count[:, 1], top["class"].to_numpy()[:frequent].astype(np.int64), 1)
    class_total = class_count[:, 0] + LOW * (class_count[:, 1] + 1)
    mass = np.concatenate([top["c"].to_numpy()[:frequent] + LOW, class_total, [ends + LOW]])
    return Vocabulary(
        top["token"].to_numpy().astype(np.int64).view(np.uint64)[order], top["c"].to_numpy().astype(np.int64)[order], np.where(rank < frequent, rank, -1),
        class_total, mass / mass.sum(), total + ends, types + (ends > 0), ends,
    )


@dataclass
class Model:
    start: np.ndarray  # of a text's first token
    middle: np.ndarray  # of a chunk's first token, in training
    move: np.ndarray  # from state, to state
    emit: np.ndarray  # symbol, state


def sequences(w: bytewords.Words, symbols: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols with their ends, one text behind the other, and where each text begins."""
    at = w.at + np.arange(len(w.at))
    out = np.full(at[-1], end, dtype=np.int64)
    out[np.arange(len(symbols)) + np.repeat(np.arange(len(w.at) - 1), w.counts)] = symbols
    return out, at


def _by_length(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the sequences, longest first; where they begin; their lengths; how many go on at each step."""
    lengths = np.diff(at)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    return order, at[:-1][order], lengths, active


def log_likelihoods(model: Model, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence of symbols, by scaled forward recursion."""
    order, first, _, active = _by_length(at)
    out = np.zeros(len(order))
    state = np.repeat(model.start[None, :], len(order), axis=0)
    for t, n in enumerate(active.tolist()):
        state = (state[:n] if t == 0 else state[:n] @ model.move) * model.emit[symbols[first[:n] + t]]
        scale = state.sum(axis=1)
        state /= scale[:, None]
        out[:n] += np.log10(scale)
    back = np.empty_like(out)
    back[order] = out
    return back


def expected_counts(model: Model, symbols: np.ndarray, at: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, middles, moves and emissions of the sequences, and their log-likelihood. opens: whether a text begins there."""
    order, first, lengths, active = _by_length(at)
    states, steps = len(model.start), len(active)
    offsets = np.concatenate(([0], np.cumsum(active)))
    alpha, emitted, scales = np.empty((offsets[-1], states)), np.empty((offsets[-1], states)), np.empty(offsets[-1])
    flat = np.empty(offsets[-1], dtype=np.int64)
    now = np.where(opens[order][:, None], model.start, model.middle)
    for t in range(steps):
        n, a, b = active[t], offsets[t], offsets[t + 1]
        flat[a:b] = symbols[first[:n] + t]
        emitted[a:b] = model.emit[flat[a:b]]
        now = (now[:n] if t == 0 else now[:n] @ model.move) * emitted[a:b]
        scales[a:b] = now.sum(axis=1)
        now /= scales[a:b, None]
        alpha[a:b] = now
    moves = np.zeros((states, states))
    gamma = np.empty_like(alpha)
    beta = np.ones((len(order), states))
    for t in range(steps - 1, -1, -1):
        n, a, b = active[t], offsets[t], offsets[t + 1]
        gamma[a:b] = alpha[a:b] * beta[:n]
        gamma[a:b] /= gamma[a:b].sum(axis=1)[:, None]
        if t:
            m = active[t - 1]
            onward = emitted[a:b] * beta[:n] / scales[a:b, None]
            moves += (alpha[offsets[t - 1] : offsets[t - 1] + n].T @ onward) * model.move
            beta = np.ones((m, states))
            beta[:n] = onward @ model.move.T
    emissions = np.stack([np.bincount(flat, weights=gamma[:, k], minlength=len(model.emit)) for k in range(states)], axis=1)
    begun = gamma[: active[0]] if steps else np.zeros((0, states))
    is_open = opens[order][: len(begun)]
    return begun[is_open].sum(axis=0), begun[~is_open].sum(axis=0), moves, emissions, float(np.log10(scales).sum())


def chunks(at: np.ndarray, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """The sequences cut into pieces of size tokens at most: where they begin, and whether a text begins there."""
    lengths = np.diff(at)
    pieces = np.maximum(-(-lengths // size), 1)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.append(np.repeat(at[:-1], pieces) + nth * size, at[-1]), nth == 0


def _shares(texts: list[tuple[np.ndarray, np.ndarray]], top: np.ndarray) -> np.ndarray:
    """Square roots of the texts' shares of the top symbols. texts: symbols and their counts."""
    column = np.full(int(max([int(top.max(initial=0)), *(int(s.max(initial=0)) for s, _ in texts)])) + 1, -1, dtype=np.int64)
    column[top] = np.arange(len(top))
    x = np.zeros((len(texts), len(top)), dtype=np.float32)
    for i, (symbols, counts) in enumerate(texts):
        at = column[symbols]
        x[i, at[at >= 0]] = counts[at >= 0] / max(counts.sum(), 1)
    return np.sqrt(x)


def first_centers(sample: list[tuple[np.ndarray, np.ndarray]], top: np.ndarray, states: int) -> np.ndarray:
    """Centers of clusters of whole texts, farthest first and then k-means."""
    x, sizes = _shares(sample, top), np.array([c.sum() for _, c in sample])
    chosen = [int(np.argmax(sizes))]
    while len(chosen) < min(states, len(x)):
        far = np.min([((x - x[c]) ** 2).sum(axis=1) for c in chosen], axis=0) * (sizes >= 20)
        chosen.append(int(np.argmax(far)))
    centers = x[chosen]
    for _ in range(15):
        near = _nearest(x, centers)
        centers = np.stack([x[near == k].mean(axis=0) if (near == k).any() else centers[k] for k in range(len(centers))])
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers**2).sum(axis=1)[None] - 2 * x @ centers.T, axis=1)


def first_model(vocab: Vocabulary, own: np.ndarray | None, states: int) -> Model:
    """own: the counts of each symbol (row) in the texts of each cluster (column)."""
    emit = np.repeat(vocab.shares[:, None], states, axis=1)
    if own is not None:
        emit[:, : own.shape[1]] = (own + PRIOR * vocab.shares[:, None]) / (own.sum(axis=0) + PRIOR)
    even = np.full(states, 1 / states)
    return Model(even, even, np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit)


def clustered(coded: DataFrame, vocab: Vocabulary, states: int) -> np.ndarray | None:
    """The counts of each symbol in all texts that are nearest to each center; None without texts."""
    spark = coded.sparkSession
    name = F.xxhash64("symbols").alias("name")
    last = coded.select(name).distinct().orderBy("name").limit(SEED_TEXTS).agg(F.max("name")).first()[0]
    if last is None:
        return None
    kind = "name long, symbols array<long>, counts array<long>"

    def sparse(batches):
        for batch in batches:
            found = [np.unique(np.frombuffer(x.as_buffer(), dtype=np.uint16), return_counts=True) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.astype(np.int64) for s, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.list_(pa.int64()))], ["name", "symbols", "counts"])

    picked = coded.select(name, "symbols").filter(F.col("name") <= last).dropDuplicates(["name"]).mapInArrow(sparse, kind)
    sample = [(np.array(r["symbols"]), np.array(r["counts"])) for r in picked.orderBy("name").collect()]  # SEED_TEXTS rows of as many numbers as symbols, at most
    size, top = len(vocab.shares), np.argsort(-vocab.shares[:-1], kind="stable")[:600]
    shared = spark.sparkContext.broadcast((first_centers(sample, top, states), top))

    def run(batches):
        centers, top = shared.value
        own = np.zeros((size, len(centers)))
        for part in bytewords.blocks(batches, "symbols", 1_500_000):
            texts = [np.unique(np.frombuffer(x.as_buffer(), dtype=np.uint16), return_counts=True) for x in part.column(0)]
            for (symbols, counts), k in zip(texts, _nearest(_shares(texts, top), centers).tolist(), strict=True):
                own[symbols, k] += counts
        used = np.flatnonzero(own.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(own[used, k].copy()) for k in range(len(centers)))], ["row", *(f"e{k}" for k in range(len(centers)))])

    columns = [f"e{k}" for k in range(len(shared.value[0]))]
    summed = coded.mapInArrow(run, "row long, " + ", ".join(f"{c} double" for c in columns)).groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toArrow().to_pandas()
    own = np.zeros((size, len(columns)))
    own[summed["row"].to_numpy()] = summed[columns].to_numpy()
    return own


def updated(model: Model, vocab: Vocabulary, start: np.ndarray, middle: np.ndarray, moves: np.ndarray, emissions: np.ndarray) -> Model:
    share = lambda x, low: (x + low) / (x.sum(axis=-1, keepdims=True) + low * x.shape[-1])
    return Model(share(start, 0.1), share(middle, 0.1), share(moves, 0.1), (emissions + PRIOR * vocab.shares[:, None]) / (emissions.sum(axis=0) + PRIOR))


def baum_welch(coded: DataFrame, vocab: Vocabulary, *, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model after so many rounds over all rows of coded (symbols, as 16-bit numbers), and the log-likelihood before each."""
    spark = coded.sparkSession
    model, history = first_model(vocab, clustered(coded, vocab, states), states), []
    size = len(vocab.shares)
    columns = [f"e{k}" for k in range(states)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            model = shared.value
            start, middle, moves, emissions, total = np.zeros(states), np.zeros(states), np.zeros((states, states)), np.zeros((size, states)), 0.0
            for part in bytewords.blocks(batches, "symbols", 1_500_000):
                texts = [np.frombuffer(x.as_buffer(), dtype=np.uint16) for x in part.column(0)]
                at = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
                pieces, opens = chunks(at)
                got = expected_counts(model, np.concatenate(texts).astype(np.int64), pieces, opens)
                start, middle, moves, emissions, total = start + got[0], middle + got[1], moves + got[2], emissions + got[3], total + got[4]
            used = np.flatnonzero(emissions.sum(axis=1))
            table = np.concatenate([emissions[used], moves, [start, middle], [[total] + [0.0] * (states - 1)]])
            name = np.concatenate([used, size + np.arange(states + 3)])
            yield pa.RecordBatch.from_arrays([pa.array(name), *(pa.array(table[:, k].copy()) for k in range(states))], ["row", *columns])

        summed = coded.mapInArrow(run, "row long, " + ", ".join(f"{c} double" for c in columns)).groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toArrow().to_pandas()
        table = np.zeros((size + states + 3, states))
        table[summed["row"].to_numpy()] = summed[columns].to_numpy()
        history.append(float(table[-1, 0]))
        model = updated(model, vocab, table[-3], table[-2], table[size : size + states], table[:size])
        shared.unpersist()
    return model, history


def fit(train: DataFrame, *, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, Vocabulary, DataFrame, list[float]]:
    """The model of the rows' texts, their vocabulary, and the counts of all their tokens. train: doc, text."""
    spark = train.sparkSession
    counts = store(token_counts(train), "tokens")
    vocab = vocabulary(counts, train.count())
    shared = spark.sparkContext.broadcast(vocab)

    def run(batches):
        vocab = shared.value
        for part in bytewords.blocks(batches, "text", BLOCK):
            w = bytewords.cut(part.column(0).to_pylist(), bytewords.WHITESPACE)
            symbols, at = sequences(w, vocab.look_up(w)[1], vocab.end)
            raw = symbols.astype(np.uint16).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[2 * a : 2 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], ["symbols"])

    coded = store(train.select("text").mapInArrow(run, "symbols binary"), "symbols")
    model, history = baum_welch(coded, vocab, states=states, rounds=rounds)
    return model, vocab, counts, history


def score(docs: DataFrame, train: DataFrame, *, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc, n_tokens, n_known, train_tokens, base_score, score of each row of docs, behind its other columns, which pass through whatever they are called."""
    model, vocab, counts, _ = fit(train.select(F.col(text).alias("text")), **options)
    shared = docs.sparkSession.sparkContext.broadcast((model, vocab))
    others = [c for c in docs.columns if c not in (doc, text)]
    extra = [f"passed {k}" for k in range(len(others))]
    docs = docs.select(F.col(doc).alias("doc"), *(F.col(f"`{c}`").alias(e) for c, e in zip(others, extra, strict=True)), F.col(text).alias("text"))
    bottom = math.log10(max(vocab.tokens + LOW * (vocab.types + 1), 1e-300))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")

    def run(batches):
        model, vocab = shared.value
        seen: set[bytes] = set()
        spread = np.log10(vocab.class_total)
        for part in bytewords.blocks(batches, "text", BLOCK):
            w = bytewords.cut(part.column(part.num_columns - 1).to_pylist(), bytewords.WHITESPACE)
            count, symbol, group = vocab.look_up(w)
            symbols, at = sequences(w, symbol, vocab.end)
            texts = len(w.at) - 1
            owner = np.repeat(np.arange(texts), w.counts)
            add = lambda v, owner=owner, texts=texts: np.bincount(owner, weights=v, minlength=texts)
            here, inner = np.log10(np.maximum(count, 0) + LOW) * (count >= 0), group >= 0
            own = add(here)
            within = add(np.where(inner, here - spread[np.maximum(group, 0)], 0.0))
            likely = log_likelihoods(model, symbols, at) + within
            known = add((count > 0).astype(float)) + (vocab.ends > 0)
            base = own + math.log10(vocab.ends + LOW)
            raw = w.hashes.tobytes()
            name = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True)]
            tails, sizes = [], []
            far = count < 0
            order = np.flatnonzero(far)
            edges = np.searchsorted(owner[order], np.arange(texts + 1))
            for i in range(texts):
                mine = order[edges[i] : edges[i + 1]]
                if len(mine) and name[i] not in seen:
                    if len(seen) < HELD:
                        seen.add(name[i])
                    types, times = np.unique(w.hashes[mine], return_counts=True)
                    tails.append(_signed(types))
                    sizes.append(times)
                else:
                    tails.append(np.zeros(0, np.int64))
                    sizes.append(np.zeros(0, np.int64))
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in tails]))), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x in (tails, sizes)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(name, pa.binary()), pa.array(w.counts + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(likely), pa.array(np.diff(edges) > 0), *lists],
                [*part.schema.names[:-1], "text_name", "n_tokens", "known", "base", "likely", "open", "rare", "times"],
            )

    found = store(docs.mapInArrow(run, kind + ", text_name binary, n_tokens long, known long, base double, likely double, `open` boolean, rare array<long>, times array<long>"), "scored")
    # tokens beyond the broadcast ones: one row for each of them and distinct text, joined to all counts
    rare = found.filter(F.size("rare") > 0).select("text_name", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("text_name", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    rare = rare.repartition("token").groupBy("token", "text_name").agg(F.min("times").alias("times"))
    looked = rare.join(counts.select("token", "c"), "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = looked.groupBy("text_name").agg(F.sum(F.col("times") * F.log10(F.col("c") + LOW)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    joined = found.drop("rare", "times").join(sums, "text_name", "left")
    more = F.coalesce("more", F.lit(0.0))
    results = {
        "n_tokens": F.col("n_tokens"), "n_known": F.col("known") + F.coalesce("more_known", F.lit(0)), "train_tokens": F.lit(vocab.tokens).cast("long"),
        "base_score": F.col("base") + more - F.col("n_tokens") * bottom, "score": F.col("likely") + more,
    }
    taken = docs.sparkSession.createDataFrame([], T.StructType([T.StructField(c, T.LongType()) for c in ["doc", *others]]))
    return joined.select("doc", *(F.col(f"`{e}`").alias(c) for c, e in zip(others, extra, strict=True)), *(v.alias(fresh(taken, k)) for k, v in results.items()))


def held_out(doc: str = "doc_id") -> Column:
    return remainder(doc, 10) == 0


def digest(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return score(rows, docs.filter(~held_out())).withColumnRenamed("doc", "doc_id")
