"""Benchmark decontamination with training suffix arrays.

Each shard (a block of training texts inside a task) gets a suffix array over words: the places where a suffix
starts, sorted by the words that follow. It is sparse: a place is kept only if its first two words open some test
window, since no other suffix can match one. Every test suffix of a window's length or more is then binary-searched in every shard by its
first window; the range it finds holds all verbatim occurrences with their locations. The suffixes that follow one another on one diagonal
(the same distance between the item's words and the document's) join to the longest verbatim match.

The test side is cut into chunks of bounded size, each of them broadcast; a shard goes through all chunks. The training
side is never shuffled and never leaves its task.

Defined cases: a null or empty text has no words and no hit; an item without words has no window; an item whose id is
null marks words but is in no list of items; repeated rows are judged one by one; empty tables give empty or clean
results; columns of other names pass through, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotweave.llm import bytewords
from plotweave.llm.common import annotate

#: Words in a window.
WINDOW = 10
#: Bytes of training text in a shard, and of test text in a broadcast chunk.
SHARD_BYTES, CHUNK_BYTES = 4_000_000, 32_000_000

MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("doc_word", T.LongType()), T.StructField("item_word", T.LongType()), T.StructField("n_words", T.LongType())])
REPORT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("contaminated", T.BooleanType()), T.StructField("matches", T.ArrayType(MATCH)),
])


def _keys(hashes: np.ndarray, places: np.ndarray, stop: np.ndarray, depth: int) -> np.ndarray:
    """The depth words from each place on as one sortable string of bytes; zeros from stop on."""
    out = np.zeros((len(places), depth), dtype=">u8")
    for k in range(depth):
        at = places + k
        ok = at < stop
        out[ok, k] = hashes[at[ok]]
    return out.reshape(-1).view(f"S{8 * depth}") if len(places) else np.zeros(0, dtype=f"S{8 * depth}")


@dataclass
class TestWindows:
    """The distinct windows of a chunk of the test side, by their number of words, sorted; who has them and where."""

    keys: dict[int, np.ndarray]  # number of words -> sorted keys
    first: dict[int, np.ndarray]  # number of words -> where the owners of key i begin
    owner: dict[int, list[tuple[str | None, int]]]  # number of words -> (item, word in the item)
    pairs: np.ndarray  # sorted hashes of the first two words of windows
    singles: np.ndarray  # sorted hashes of windows of one word
    table: np.ndarray  # a bit for each low end of a pair's hash


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return bytewords.mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def test_windows(items: list[tuple[str | None, str | None]], window: int) -> TestWindows:
    w = bytewords.cut([t for _, t in items], bytewords.ALNUM)
    found: dict[int, tuple[list, list]] = {}
    for i, (item, _) in enumerate(items):
        begin, end = int(w.at[i]), int(w.at[i + 1])
        n = min(window, end - begin)
        if n:
            places = np.arange(begin, end - n + 1)
            keys, owners = found.setdefault(n, ([], []))
            keys.append(_keys(w.hashes, places, np.full(len(places), end), n))
            owners += [(item, p - begin) for p in places.tolist()]
    out = TestWindows({}, {}, {}, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(1 << 20, bool))
    pairs = []
    for n, (keys, owners) in found.items():
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        distinct, first = np.unique(flat[order], return_index=True)
        out.keys[n], out.first[n], out.owner[n] = distinct, np.append(first, len(flat)), [owners[k] for k in order.tolist()]
        words = np.frombuffer(distinct.tobytes(), dtype=">u8").reshape(-1, n).astype(np.uint64)
        if n == 1:
            out.singles = np.unique(words[:, 0])
        else:
            pairs.append(_pair(words[:, 0], words[:, 1]))
    if pairs:
        out.pairs = np.unique(np.concatenate(pairs))
        out.table[(out.pairs & np.uint64(0xFFFFF)).astype(np.int64)] = True
    return out


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(ordered, values)
    return ordered[np.minimum(at, len(ordered) - 1)] == values


def suffix_array(w: bytewords.Words, tests: TestWindows, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shard's suffixes that can open a window, sorted by their words, and the sorted keys."""
    n = len(w.hashes)
    stop = np.repeat(w.at[1:], np.diff(w.at))
    kept = np.zeros(n, dtype=bool)
    if n > 1 and len(tests.pairs):
        both = _pair(w.hashes[:-1], w.hashes[1:])
        maybe = np.flatnonzero(tests.table[(both & np.uint64(0xFFFFF)).astype(np.int64)])
        maybe = maybe[maybe + 1 < stop[maybe]]
        kept[maybe[_member(both[maybe], tests.pairs)]] = True
    if len(tests.singles):
        kept |= _member(w.hashes, tests.singles)
    places = np.flatnonzero(kept)
    keys = _keys(w.hashes, places, stop[places], depth)
    order = np.argsort(keys, kind="stable")
    return places[order], keys[order]


def _after(keys: np.ndarray, n: int, depth: int) -> np.ndarray:
    """The largest key that begins with each of the keys of n words."""
    out = np.full((len(keys), depth), 0xFFFFFFFFFFFFFFFF, dtype=">u8")
    out[:, :n] = np.frombuffer(keys.tobytes(), dtype=">u8").reshape(-1, n)
    return out.reshape(-1).view(f"S{8 * depth}")


def occurrences(w: bytewords.Words, tests: TestWindows, depth: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(words in the window, which distinct window, places in the shard) of each window that occurs."""
    places, ordered = suffix_array(w, tests, depth)
    if not len(places):
        return
    for n, keys in tests.keys.items():
        low = np.searchsorted(ordered, keys.astype(f"S{8 * depth}"), side="left")
        high = np.searchsorted(ordered, _after(keys, n, depth), side="right")
        for k in np.flatnonzero(high > low).tolist():
            yield n, k, places[low[k] : high[k]]


def _judge(w: bytewords.Words, chunks: Iterator[TestWindows], depth: int, locations: bool) -> list[dict]:
    """The report of each text of the shard."""
    texts = len(w.at) - 1
    hits = np.zeros(len(w.hashes) + 1, dtype=np.int64)  # +1 where a window begins, -1 behind its end
    items: list[set] = [set() for _ in range(texts)]
    touched: list[set] = [set() for _ in range(texts)] if locations else []
    for tests in chunks:
        for n, k, places in occurrences(w, tests, depth):
            np.add.at(hits, places, 1)
            np.add.at(hits, places + n, -1)
            docs = np.searchsorted(w.at, places, side="right") - 1
            owners = tests.owner[n][tests.first[n][k] : tests.first[n][k + 1]]
            named = {o[0] for o in owners if o[0] is not None}
            for d in np.unique(docs).tolist():
                items[d] |= named
            if locations:
                for d, p in zip(docs.tolist(), places.tolist(), strict=True):
                    touched[d].update((item, p - int(w.at[d]) - q, q, n) for item, q in owners)
    covered = np.cumsum(hits[:-1]) > 0
    total = np.concatenate(([0], np.cumsum(covered)))
    counts, hit = w.counts, total[w.at[1:]] - total[w.at[:-1]]
    return [
        {"n_words": int(counts[d]), "n_hit": int(hit[d]), "items": sorted(items[d]), "contaminated": bool(hit[d]), "matches": _longest(touched[d]) if locations else []}
        for d in range(texts)
    ]


def _longest(found: set) -> list[dict]:
    """Windows that follow one another on a diagonal, joined."""
    out: list[dict] = []
    last = None
    for item, diagonal, q, n in sorted(found, key=lambda x: (x[0] is None, x[0] or "", x[1], x[2])):
        if last == (item, diagonal) and q <= out[-1]["item_word"] + out[-1]["n_words"]:
            out[-1]["n_words"] = max(out[-1]["n_words"], q + n - out[-1]["item_word"])
        else:
            out.append({"item_id": item, "doc_word": diagonal + q, "item_word": q, "n_words": n})
        last = (item, diagonal)
    return sorted(out, key=lambda m: (m["doc_word"], m["item_id"] or "", m["item_word"]))


def report(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, locations: bool = False) -> tuple[DataFrame, str]:
    """docs with a struct column (REPORT), and that column's name. matches is empty unless locations are asked for."""
    spark = docs.sparkSession
    chunks, rows, size = [], [], 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(item_text)).toLocalIterator():
        rows.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= CHUNK_BYTES:
            chunks.append(spark.sparkContext.broadcast(test_windows(rows, window)))
            rows, size = [], 0
    chunks.append(spark.sparkContext.broadcast(test_windows(rows, window)))
    kind = pa.struct([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("contaminated", pa.bool_()),
        ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))),
    ])

    def work(batches):
        for part in bytewords.blocks(batches, text, SHARD_BYTES):
            w = bytewords.cut(part.column(part.schema.get_field_index(text)).to_pylist(), bytewords.ALNUM)
            yield part, pa.array(_judge(w, (c.value for c in chunks), window, locations), type=kind)

    return annotate(docs, [text], "decontamination", REPORT, work)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that contain a window of the benchmark."""
    found, name = report(docs, benchmark, **options)
    return found.filter(~F.col(f"{name}.contaminated")).drop(name)


def digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row; longest and longest_at: the words of its longest verbatim match
    and the first of the document's words where one of that length begins (0 and null without a match)."""
    found, name = report(docs.select("doc_id", "text"), benchmark, locations=True, **options)
    r = F.col(name)
    best = F.array_max(F.transform(r.matches, lambda m: F.struct(m.n_words.alias("n"), (-m.doc_word).alias("at"))))
    return found.select(
        "doc_id", r.n_words.alias("n_words"), r.n_hit.alias("n_hit"), F.size(r["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", r["items"]), 256).alias("items_sha256"), r.contaminated.alias("contaminated"),
        F.coalesce(best.n, F.lit(0)).cast("long").alias("longest"), (-best["at"]).alias("longest_at"),
    )


#: The digest of the plain form, for tests.
def plain_digest(text: str | None, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> tuple[int, int, int, str, bool, int, int | None]:
    from plotweave.llm.common import split_words

    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words, hit, found, longest = split_words(pattern, text), set(), set(), (0, 0)
    for item, t in items:
        own = split_words(pattern, t)
        n = min(window, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found |= {item} - {None}
                for j in range(len(own) - n + 1):
                    if own[j : j + n] == words[i : i + n]:
                        k = n
                        while i + k < len(words) and j + k < len(own) and words[i + k] == own[j + k]:
                            k += 1
                        longest = max(longest, (k, -i))
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), sha, bool(hit), longest[0], -longest[1] if longest[0] else None
