"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that give it away.

Fixed patterns find protected entities: mail addresses, IP addresses, payment cards and phone numbers. The corpus then tells which
other terms reveal them. For each entity and each term within WINDOW words of it, the distinct texts with both are counted,
and for each such term the distinct texts that have it anywhere. The pointwise mutual information of term and entity, as a share of
the entity's own information, -log p(entity), says how much of the entity the term discloses: 1 if it occurs with the entity alone. Terms whose
share is over the threshold, and whose meeting with the entity chance doesn't explain at the level CHANCE, are spans of kind term wherever
they occur: generalised where other texts have them too, removed where only the entity's have. No number of texts is needed: an
entity of one text discloses too. Chance is Chernoff's bound on the share of the entity's texts that would have the term if they
were drawn from all texts; for an entity of one text that is the share of all texts that have the term.

Counts cover all rows; copies of a text count once. Pairs are counted within a window, so that a text's cost grows
with its length only, and are added up before and after the shuffle. Terms that disclose are broadcast in chunks of bounded
size.

Defined cases: a null text is empty and has no spans; repeated rows have equal spans; an empty table gives an empty one; columns of
other names pass through.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotweave.llm import bytewords
from plotweave.llm.common import annotate, store

KINDS = ("email", "ip", "card", "phone", "term")
#: Words to either side of an entity; share of the entity's information; level of significance.
WINDOW, DISCLOSURE, CHANCE = 10, 0.9, 0.05
#: Candidate terms, and terms that disclose, in a broadcast; more are handled without one, or in several.
CANDIDATES, CHUNK = 2_000_000, 2_000_000
#: The patterns of the base kinds after the first character classes, and what stands for a span.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that can't open an address from its first digit can't from a later one
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_NO_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the run of local characters before it (from the last match on) and a domain behind it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            out.append((begin, domain.end()))
            last = domain.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the base kinds, in order."""
    text = text or ""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())] if "." in text else []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def entity(text: str, span: tuple[int, int, int]) -> int:
    """The entity that a span names: its kind and characters, of numbers the digits alone."""
    value = text[span[0] : span[2]].lower()
    return _hash(KINDS[span[1]].encode(), (_NO_DIGIT.sub("", value) if span[1] in (2, 3) else value).encode("utf-8", "surrogatepass"))


def words_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in WORD.finditer(text.translate(_LOWER))]


def contexts(text: str, spans: list[tuple[int, int, int]]) -> set[tuple[int, int]]:
    """(entity, hash of a word near it) of a text; words inside of spans are left out."""
    places = words_of(text)
    starts = [a for a, _ in places]
    lowered = text.translate(_LOWER)
    inside = [False] * len(places)
    near = []
    for s in spans:
        i = bisect.bisect_left(starts, s[0])
        while i > 0 and places[i - 1][1] > s[0]:
            i -= 1
        j = i
        while j < len(places) and places[j][0] < s[2]:
            inside[j] = True
            j += 1
        near.append((entity(text, s), range(max(0, i - WINDOW), min(len(places), j + WINDOW))))
    pairs = {(e, k) for e, ks in near for k in ks if not inside[k]}
    if not pairs:
        return set()
    used = sorted({k for _, k in pairs})
    hashes = bytewords.cut([lowered[places[k][0] : places[k][1]] for k in used], bytewords.ALNUM).hashes.view(np.int64).tolist()
    of = dict(zip(used, hashes, strict=True))
    return {(e, of[k]) for e, k in pairs}


def _ordered(terms: DataFrame) -> np.ndarray:
    return np.sort(terms.toArrow().to_pandas()["term"].to_numpy().astype(np.int64).view(np.uint64))


def _rare_enough(docs: DataFrame, terms: DataFrame, met: DataFrame, total: int) -> DataFrame:
    """The terms that aren't known to be in too many texts to disclose anything: each task counts its own texts, which bounds the number from below."""
    limit = met.groupBy("term").agg(F.max(F.col("both") * F.pow(total / F.col("entity_texts"), 1 - DISCLOSURE)).alias("limit"))
    known = docs.sparkSession.sparkContext.broadcast(_ordered(terms))

    def run(batches):
        terms, seen = known.value, set()
        counts = np.zeros(len(terms), dtype=np.int64)
        for part in bytewords.blocks(batches, "text", 4_000_000):
            texts = part.column(0).to_pylist()
            new = np.zeros(len(texts), dtype=bool)
            for i, t in enumerate(texts):
                name = hash(t)
                new[i] = name not in seen and len(seen) < CANDIDATES
                if new[i]:
                    seen.add(name)
            w = bytewords.cut(texts, bytewords.ALNUM)
            owner = np.repeat(np.arange(len(texts)), w.counts)
            if len(terms):
                at = np.minimum(np.searchsorted(terms, w.hashes), len(terms) - 1)
                kept = (terms[at] == w.hashes) & new[owner]
                pairs = np.unique(np.stack([at[kept], owner[kept]]), axis=1)
                counts += np.bincount(pairs[0], minlength=len(terms))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(terms[used].view(np.int64)), pa.array(counts[used])], ["term", "n"])

    least = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.max("n").alias("n"))
    return store(least.join(limit, "term").filter(F.col("n") <= F.col("limit") * (1 + 1e-9)).select("term"), "terms")


def _chance(total: int):
    """Chernoff's bound on the log of the chance that entity_texts texts, drawn from all, include both or more that have the term."""
    both, of, have = (F.col(c).cast("double") for c in ("both", "entity_texts", "have"))
    rest = F.when(both < of, (of - both) * F.log((of - both) * total / (of * F.greatest(total - have, F.lit(1.0))))).otherwise(0.0)
    return F.when(both * total <= of * have, 0.0).otherwise(-(both * F.log(both * total / (of * have)) + rest))


def disclosing(docs: DataFrame) -> DataFrame:
    """term, share, alone (whether only texts with the entity have the term) of the terms that disclose an entity. docs: text."""
    spark = docs.sparkSession

    def near(batches):
        seen: set[bytes] = set()
        for part in bytewords.blocks(batches, "text"):
            rows = []
            for text in part.column(0).to_pylist():
                if text and (spans := base_spans(text)):
                    name = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                    if name not in seen:
                        if len(seen) < CANDIDATES:
                            seen.add(name)
                        key = int.from_bytes(name, "little", signed=True)
                        rows += [(e, t, key) for e, t in contexts(text, spans)]
                        rows += [(e, 0, key) for e in {entity(text, s) for s in spans}]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["entity", "term", "text"])

    met = docs.select("text").mapInArrow(near, "entity long, term long, text long").distinct().groupBy("entity", "term").agg(F.count("*").alias("both"))
    met = store(met, "met")
    terms = met.filter("term != 0").select("term").distinct()
    few = terms.limit(CANDIDATES + 1).count() <= CANDIDATES
    own = met.filter("term = 0").select("entity", F.col("both").alias("entity_texts"))
    body = F.coalesce("text", F.lit(""))
    total = max(docs.select(F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body).alias("b")).distinct().count(), 2)
    met = met.filter("term != 0").join(own, "entity")
    if few:
        terms = _rare_enough(docs, terms, met, total)
    wanted = spark.sparkContext.broadcast(_ordered(terms) if few else None)

    def have(batches):
        seen: set[bytes] = set()
        for part in bytewords.blocks(batches, "text", 4_000_000):
            texts = part.column(0).to_pylist()
            w = bytewords.cut(texts, bytewords.ALNUM)
            owner = np.repeat(np.arange(len(texts)), w.counts)
            hashes = w.hashes
            if (known := wanted.value) is not None:
                if not len(known):
                    continue
                kept = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
                hashes, owner = hashes[kept], owner[kept]
            names = {i: hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=8).digest() for i in np.unique(owner).tolist()}
            fresh = np.zeros(len(texts), dtype=bool)
            for i, name in names.items():
                fresh[i] = name not in seen
                if len(seen) < CANDIDATES:
                    seen.add(name)
            kept = fresh[owner]
            pairs = np.unique(np.stack([hashes[kept], owner[kept].astype(np.uint64)]), axis=1)
            keys = np.zeros(len(texts), dtype=np.int64)
            for i, name in names.items():
                keys[i] = int.from_bytes(name, "little", signed=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[0]).view(np.int64)), pa.array(keys[pairs[1].astype(np.int64)])], ["term", "text"])

    held = docs.select("text").mapInArrow(have, "term long, text long").distinct().groupBy("term").agg(F.count("*").alias("have"))
    share = F.log(F.col("both") * total / (F.col("have") * F.col("entity_texts"))) / F.log(F.lit(float(total)) / F.col("entity_texts"))
    found = met.join(held, "term").withColumn("share", F.when(F.col("entity_texts") < total, share))
    return found.filter((F.col("share") >= DISCLOSURE) & (_chance(total) <= math.log(CHANCE))).groupBy("term").agg(F.max("share").alias("share"), F.max(F.col("both") >= F.col("have")).alias("alone"))


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("stop", T.LongType()), T.StructField("alone", T.BooleanType())]))


def scan(docs: DataFrame, *, text: str = "text") -> tuple[DataFrame, str]:
    """docs with a column of spans (SPAN, in order; rank: place in KINDS), and its name."""
    spark = docs.sparkSession
    chunks, rows = [], []

    def send():
        rows.sort()
        chunks.append(spark.sparkContext.broadcast((np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows], dtype=bool))))
        rows.clear()

    for row in store(disclosing(docs.select(F.col(text).alias("text"))), "terms").toLocalIterator():
        rows.append((row["term"] % 2**64, row["alone"]))
        if len(rows) >= CHUNK:
            send()
    send()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("stop", pa.int64()), ("alone", pa.bool_())]))

    def work(batches):
        for part in bytewords.blocks(batches, text, 4_000_000):
            texts = part.column(part.schema.get_field_index(text)).to_pylist()
            w = bytewords.cut(texts, bytewords.ALNUM)
            told = np.zeros(len(w.hashes), dtype=np.int8)
            for c in chunks:
                terms, alone = c.value
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, w.hashes), len(terms) - 1)
                    told = np.maximum(told, np.where(terms[at] == w.hashes, 1 + alone[at], 0).astype(np.int8))
            out = []
            for i, t in enumerate(texts):
                spans = [(*s, False) for s in base_spans(t)]
                mine = told[w.at[i] : w.at[i + 1]]
                if mine.any():
                    places = words_of(t)
                    more = [(*places[k], mine[k] == 2) for k in np.flatnonzero(mine).tolist()]
                    starts, ends = [s[0] for s in spans], [-1, *itertools.accumulate((s[2] for s in spans), max)]
                    spans = sorted(spans + [(a, 4, b, alone) for a, b, alone in more if ends[bisect.bisect_left(starts, b)] <= a])
                out.append([{"start": a, "rank": r, "stop": b, "alone": bool(x)} for a, r, b, x in spans])
            yield part, pa.array(out, type=kind)

    return annotate(docs, [text], "pii_spans", SPAN, work)


def listed(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x.rank + 1), x.start.cast("string"), x.stop.cast("string"))), ",")


def sanitise(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with entities replaced by their kind, disclosing terms by [TERM], or by nothing where only the entity's texts have them."""
    found, name = scan(docs, text=text)
    body = F.col(text)
    mask = lambda x: F.when(x.rank < 4, F.element_at(F.array(*(F.lit(MASKS[k]) for k in KINDS[:4])), x.rank + 1)).when(x.alone, "").otherwise("[TERM]")

    def add(acc, x):
        gap = F.substring(body, (acc.at + 1).cast("int"), (x.start - acc.at).cast("int"))
        return F.when(x.start >= acc.at, F.struct(F.concat(acc.out, gap, mask(x)).alias("out"), x.stop.alias("at"))).otherwise(F.struct(acc.out.alias("out"), F.greatest(acc.at, x.stop).alias("at")))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    clean = F.aggregate(F.col(name), start, add, lambda acc: F.concat(acc.out, F.substring(body, (acc.at + 1).cast("int"), F.length(body))))
    return found.withColumn(text, F.when(F.size(name) > 0, clean).otherwise(body)).drop(name)


def _only(ranks, k: int):
    return F.filter(ranks, lambda r: r == k)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, the hash of the base spans and all spans."""
    found, name = scan(docs.select("doc_id", "text"))
    spans = F.col(name)
    base = F.filter(spans, lambda x: x.rank < 4)
    ranks = F.transform(spans, lambda x: x.rank)
    counts = [F.size(_only(ranks, k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))
