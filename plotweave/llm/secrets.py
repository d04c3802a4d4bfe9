"""Secret scans in DataFrame functions only: fixed patterns, and character Markov models.

Fixed patterns find assigned secrets, access keys and long hexadecimal runs. Beyond them, each long token is scored by two
character Markov models of first order, one of random strings and one of ordinary identifiers; a token whose
log-likelihood ratio a character exceeds a threshold is a span of kind markov. The models are counted from labelled
samples. Random: SHA-256 digests in the usual encodings. Identifiers: the words of all documents, alone, joined as identifiers join them (camel
case, _ - /), and in capitals; a built-in list of common words likewise; and made numbers and rules as plain text has them: dates,
versions, counters, lines of one character. The models have at most 68 * 68 entries, whatever the corpus. Words are added up before their pairs of characters are
counted; a corpus of more pairs than the random side's is scaled down to as many, so that the fallback weighs the same at every
table size.

Places are code points. A kind's places come from the lengths of the pieces between its matches, so that they are exact
without a scan for each match.

Defined cases: a null text is empty and has no spans; repeated rows are scanned one by one; an empty table gives an empty one, and
models of the random side alone; columns of other names pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import fresh

#: The patterns of the base kinds, in the order of the kinds, and the least length that counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 8, "access": 16}

#: Words that identifiers are commonly made of, labelled samples beside the corpus's own words.
IDENTIFIER_WORDS = (
    "set value index count list string file path read write open close result error message request response handler config default update create delete find node tree parse"
    " format width height item order session manager service controller factory builder context buffer stream event listener thread process system network server client address number double integer boolean array object"
    " class function method property attribute element container component window button image color border margin position offset length size start end first last next previous parent child root leaf input output"
)

#: The characters that the models know; a token for them has 20 of them or more.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Nats a character by which the random model must be likelier.
MARGIN = 1.8
#: Matches of a text that are placed at once: the cost of a text grows with its matches times this.
STEP = 256
#: How many pairs the fallback on single characters counts as.
BACKOFF = 8.0
#: Random strings made that the models are fitted on, and rows of made numbers.
RANDOM_ROWS, NUMBER_ROWS = 4096, 4096


def _matches(docs: DataFrame, text: Column, name: str) -> DataFrame:
    """docs with a struct column: for each kind, a struct of its matches (found) and of the lengths of the gaps before them (gap).

    Two projections, so that each pattern runs once over a text, and a second time only where it has matches.
    """
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True))
    found = docs.withColumn(name, F.struct(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(k) for k, p in patterns.items())))
    gaps = lambda k, p: F.when(F.size(F.col(name)[k]) > 0, F.slice(F.transform(F.split(text, p, -1), F.length), F.lit(1), F.size(F.col(name)[k])))
    return found.withColumn(name, F.struct(*(F.struct(F.col(name)[k].alias("found"), gaps(k, p).alias("gap")).alias(k) for k, p in patterns.items())))


def _spans(matches: Column, kind: str, keep=None) -> Column:
    """array<struct<start, rank, stop>> of a kind's matches that keep (a predicate on a match) accepts."""
    rank, empty = KINDS.index(kind), "array<struct<start:long,rank:int,stop:long>>"
    both = F.arrays_zip(F.transform(matches.found, F.length).alias("n"), matches["gap"].alias("gap"), matches.found.alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(empty).alias("spans"))

    def add(acc, x):
        begin = acc.at + x.gap
        end = begin + x.n
        span = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("stop")))
        ok = keep(x.s) if keep else F.lit(True)
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    def steps(acc, part):  # a list grows by copying, so STEP matches make a list of their own
        begin = F.struct(acc.at.alias("at"), F.array().cast(empty).alias("spans"))
        done = F.element_at(F.transform(F.array(F.aggregate(part, begin, add)), lambda x: F.struct(x.at.alias("at"), F.concat(acc.parts, F.array(x.spans)).alias("parts"))), 1)
        return F.struct(done.at.alias("at"), done.parts.alias("parts"))

    parts = F.transform(F.sequence(F.lit(1), F.size(matches.found), F.lit(STEP)), lambda i: F.slice(both, i, F.lit(STEP)))
    many = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{empty}>").alias("parts")), steps, lambda acc: F.flatten(acc.parts))
    placed = F.when(F.size(matches.found) <= STEP, F.aggregate(both, start, add, lambda acc: acc.spans)).otherwise(many)
    return F.when(F.size(matches.found) > 0, placed).otherwise(F.array().cast(empty))


def identifier_strings(docs: DataFrame, text: str) -> DataFrame:
    """s, n: the words of all texts, alone and joined to their neighbours, as strings (a joint is two characters) and how often they occur."""
    words = F.filter(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[A-Za-z][A-Za-z]+"), F.lit(0)), lambda w: F.length(w) <= 40)
    found = docs.select(words.alias("w")).filter(F.size("w") > 0)
    # the word, and the capital of the word behind it
    beside = F.zip_with(F.col("w"), F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.struct(a.alias("word"), F.upper(F.substring(b, 1, 1)).alias("then")))
    placed = found.select(F.posexplode(beside).alias("at", "x")).groupBy(F.col("x.word").alias("word"), F.col("x.then").alias("then"), (F.col("at") == 0).alias("first"))
    n, before, behind = F.col("n"), F.when(F.col("then").isNull(), 0).otherwise(1), F.when(F.col("first"), 0).otherwise(1)
    # by _ - / the word as it is is joined on both sides, in camel case it is on the right with a capital
    parts = [(F.col("word"), n * (1 + 4 * before + 3 * behind)), (F.initcap("word"), n * behind), (F.concat(F.substring("word", -1, 1), "then"), n * before)]
    parts += [(F.concat(F.substring("word", -1, 1), F.lit(sep)), n * before) for sep in "_-/"] + [(F.concat(F.lit(sep), F.substring("word", 1, 1)), n * behind) for sep in "_-/"]
    strings = placed.agg(F.count("*").alias("n")).select(F.explode(F.array(*(F.struct(s.alias("s"), k.alias("n")) for s, k in parts))).alias("x"))
    return strings.select("x.s", "x.n").filter("n > 0").groupBy("s").agg(F.sum("n").alias("n"))


def number_strings(spark) -> DataFrame:
    """s: made numbers as identifiers have them, between joints and letters: dates, times, versions, counters, sizes, and rules of one character."""
    k = F.col("id")
    h = F.xxhash64(F.lit("numbers"), k)
    pick = lambda bits, n: F.pmod(F.shiftright(h, bits), F.lit(n))
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    year, month, day, hour, minute = (pick(0, 60) + 1980).cast("string"), two(pick(6, 12) + 1), two(pick(12, 28) + 1), two(pick(18, 24)), two(pick(24, 60))
    small, large, counter = pick(30, 12).cast("string"), pick(36, 100_000).cast("string"), F.lpad(pick(42, 300).cast("string"), 3, "0")
    size = F.element_at(F.array(*(F.lit(str(2**i)) for i in range(4, 15))), (pick(48, 11) + 1).cast("int"))
    letter = F.element_at(F.split(F.lit("abcdefghijklmnopqrstuvwxyz"), ""), (pick(52, 26) + 1).cast("int"))
    forms = [F.concat_ws(sep, year, month, day) for sep in ("-", "_", "", "/", ".")]
    forms += [F.concat_ws(sep, F.lit(""), year, month, day, F.lit("")) for sep in ("-", "_")] + [F.concat(year, month, day, F.lit("T"), hour, minute), F.concat_ws("_", F.concat(year, month, day), F.concat(hour, minute))]
    forms += [F.concat(mark, F.concat_ws(".", small, pick(54, 20).cast("string"), pick(58, 10).cast("string"))) for mark in (F.lit("v"), F.lit("-"), F.lit("_v"))]
    forms += [F.concat(F.lit(joint), n) for joint in "_-/" for n in (small, counter, large, size)] + [F.concat(letter, n) for n in (small, counter, size)]
    forms += [F.concat(n, F.lit(joint), letter) for joint in "_-" for n in (small, size)] + [F.concat(F.upper(letter), small), F.concat(F.lit("-v"), small, F.lit("-")), large, F.concat(large, counter)]
    forms += [F.repeat(F.lit(mark), (pick(20, 9) + 3).cast("int")) for mark in "=-_/+"]
    return spark.range(NUMBER_ROWS).select(F.explode(F.array(*forms)).alias("s"))


def labelled_strings(docs: DataFrame, text: str) -> DataFrame:
    """s, n, kind (random, common or corpus): the labelled samples that the models are counted from."""
    spark = docs.sparkSession
    made = spark.range(RANDOM_ROWS).select(F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256).alias("h"))
    encoded = F.explode(F.array(
        F.col("h"), F.base64(F.unhex("h")), F.translate(F.base64(F.unhex("h")), "+/=", "-_"), F.regexp_replace(F.base64(F.unhex("h")), "[^A-Za-z0-9]", ""),
        F.upper(F.regexp_replace(F.base64(F.unhex("h")), "[^A-Za-z0-9]", "")),
    ))
    random = made.select(encoded.alias("s"), F.lit(1).cast("long").alias("n"), F.lit("random").alias("kind"))
    known = IDENTIFIER_WORDS.split()
    common = F.array(*(F.lit(" ".join(known[k::7] * 3 + known[::-1][k::5])) for k in range(7)))
    common = identifier_strings(spark.range(7).select(F.element_at(common, (F.col("id") + 1).cast("int")).alias("t")), "t")
    numbers = number_strings(spark).groupBy("s").count()
    in_capitals = lambda rows, kind: rows.select(F.explode(F.array(F.struct("s", "n"), F.struct(F.upper("s").alias("s"), "n"))).alias("x")).select("x.s", "x.n", F.lit(kind))
    return random.union(in_capitals(common, "common")).union(numbers.select("s", "count", F.lit("common"))).union(in_capitals(identifier_strings(docs, text), "corpus"))


def fit(docs: DataFrame, *, text: str = "text") -> list[float]:
    """The log-likelihood ratio of each pair of characters, first * size + second in the alphabet's order."""
    size = len(ALPHABET)
    # the characters are bound as a lambda's argument, else they would be split anew for each pair
    held = F.array(F.filter(F.split("s", ""), lambda c: c != ""))
    steps = F.transform(held, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.concat(a, b)))
    pairs = labelled_strings(docs, text).filter(F.length("s") > 1).select("kind", "n", F.explode(F.flatten(steps)).alias("p"))
    found = {"random": {}, "common": {}, "corpus": {}}
    for row in pairs.groupBy("kind", "p").agg(F.sum("n").alias("n")).collect():  # two characters and a label: bounded by the alphabet
        if row.p and len(row.p) == 2 and row.p[0] in ALPHABET and row.p[1] in ALPHABET:
            found[row.kind][ALPHABET.index(row.p[0]) * size + ALPHABET.index(row.p[1])] = row["n"]
    scale = min(1.0, sum(found["random"].values()) / max(sum(found["corpus"].values()), 1))
    plain = {k: found["common"].get(k, 0) + scale * found["corpus"].get(k, 0) for k in found["common"].keys() | found["corpus"].keys()}
    counts = {True: found["random"], False: plain}

    # a pair that a model has rarely seen falls back on how often it has seen its second character
    after = {y: [0.05 + sum(n for k, n in of.items() if k % size == j) for j in range(size)] for y, of in counts.items()}
    before = {y: [sum(of.get(i * size + j, 0) for j in range(size)) for i in range(size)] for y, of in counts.items()}
    every = {y: sum(v) for y, v in after.items()}

    def chance(y: bool, k: int) -> float:
        return (counts[y].get(k, 0) + BACKOFF * after[y][k % size] / every[y]) / (before[y][k // size] + BACKOFF)

    return [math.log(chance(True, k) / chance(False, k)) for k in range(size * size)]


def suspicious(model: list[float]):
    """The predicate on a token that the random model is likelier than the identifiers' by MARGIN nats a character."""
    size = len(ALPHABET)
    ratios = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")  # folded to one literal

    def ratio(token):
        held = F.array(F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c)))
        total = lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(ratios, (F.element_at(p, i) - 1) * size + F.element_at(p, i + 1)))
        return F.element_at(F.transform(held, total), 1)

    return lambda m: ratio(m) >= MARGIN * F.length(m)


def scan(docs: DataFrame, model: list[float] | None = None, *, text: str = "text") -> tuple[DataFrame, str]:
    """docs with a struct column (assign, access, hex, markov: spans by kind; base, spans: all, in order), and its name."""
    model = fit(docs, text=text) if model is None else model
    name = fresh(docs, "secret_spans")
    found = _matches(docs, F.coalesce(F.col(text), F.lit("")), name)
    keep = {"assign": lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST["assign"], "access": lambda m: F.length(m) >= LEAST["access"], "hex": None, "markov": suspicious(model)}
    found = found.withColumn(name, F.struct(*(_spans(F.col(name)[k], k, keep[k]).alias(k) for k in KINDS)))
    s = F.col(name)
    found = found.withColumn(name, F.struct(*(s[k].alias(k) for k in KINDS), F.array_sort(F.concat(s["assign"], s["access"], s["hex"])).alias("base")))
    # a token that a fixed pattern has found already adds nothing
    new = F.filter(s["markov"], lambda m: ~F.exists(s["base"], lambda b: (b.start < m.stop) & (m.start < b.stop)))
    return found.withColumn(name, F.struct(*(s[k].alias(k) for k in KINDS[:3]), new.alias("markov"), s["base"].alias("base"), F.array_sort(F.concat(s["base"], new)).alias("spans"))), name


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x.rank + 1), x.start.cast("string"), x.stop.cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, the hash of the base spans and all spans."""
    found, name = scan(docs.select("doc_id", "text"))
    s = F.col(name)
    return found.select(
        "doc_id", *(F.size(s[k]).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(listed(s["base"]), 256).alias("base_sha256"), listed(s["spans"]).alias("spans")
    )


def redact(docs: DataFrame, *, text: str = "text", mask: str = "[SECRET]", **options) -> DataFrame:
    """docs whose spans are replaced by the mask (spans that overlap by one); texts without a span stay as they are."""
    found, name = scan(docs, text=text, **options)
    spans, body = F.col(name)["spans"], F.col(text)

    def add(acc, x):
        gap = F.substring(body, (acc.at + 1).cast("int"), (x.start - acc.at).cast("int"))
        fresh_part = F.struct(F.concat(acc.out, gap, F.lit(mask)).alias("out"), x.stop.alias("at"))
        return F.when(x.start >= acc.at, fresh_part).otherwise(F.struct(acc.out.alias("out"), F.greatest(acc.at, x.stop).alias("at")))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    masked = F.aggregate(spans, start, add, lambda acc: F.concat(acc.out, F.substring(body, (acc.at + 1).cast("int"), F.length(body))))
    return found.withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(body)).drop(name)
