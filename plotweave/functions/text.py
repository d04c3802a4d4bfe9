"""Text functions of the record pipeline, as column expressions; Arrow functions where a match's surroundings decide."""

from __future__ import annotations

import ast
import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Chars of text in a token where no tokenizer is at hand; the lines that must be equal in a repetition.
CHARS_A_TOKEN = 3
REPEATED_LINES = 8
#: Compass words in their order of rotation, and the Russian stems, adjectives before nouns.
COMPASS = ("north", "east", "south", "west")
COMPASS_RU = (("северн", "восточн", "южн", "западн"), ("север", "восток", "юг", "запад"))
#: What ends a line, and white space, as in Python's str.
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]"
SPACE = "[\\t-\\r\\x1C-\\x20\\x{85}\\p{Z}]"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def lines_of(text: Column) -> Column:
    """The lines of a text, without an empty one behind its last line's end."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def strip_rich_text(text: Column) -> Column:
    """Without marks in brackets ([name], [name=value], [/name], of small letters and hyphens), white space collapsed."""
    return collapse(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\[]/?[-a-z]+(?:=[^\\]]*)?[\\]]", " "))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def token_count(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_A_TOKEN)


def stable_fraction(text: Column) -> Column:
    """A number in [0, 1] from the first 32 bits of the SHA-256 of the text."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)


def stable_choice(text: Column, n: int) -> Column:
    """One of 0 to n - 1 by the same hash."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint") % n


def prompt_language(text: Column) -> Column:
    """ru if the text has a Cyrillic letter, else en."""
    return F.when(F.lower(text).rlike("[а-яё]"), "ru").otherwise("en")


def numbers(text: Column) -> Column:
    """The integers in a text, as strings, distinct."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)))


def is_grounded(text: Column, allowed: Column) -> Column:
    """Whether all integers of the text are allowed."""
    return F.size(F.array_except(numbers(text), allowed)) == 0


def allowed_numbers(counts: Column, types: Column, recipes: Column, width: Column, height: Column, total: Column, label: Column, title: Column) -> Column:
    """The integers, as strings, that a prompt may name: all counts (maps of name to count), the sizes, those of the label and the title, and 2."""
    values = lambda m: F.coalesce(F.transform(F.map_values(m), lambda v: v.cast("string")), F.array().cast("array<string>"))
    plain = lambda d: F.regexp_replace(d, "^0+(?=.)", "")
    written = F.transform(numbers(F.concat_ws(" ", strip_rich_text(label), strip_rich_text(title))), plain)
    sizes = F.filter(F.array(*(c.cast("string") for c in (width, height, total))), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(values(counts), values(types), values(recipes), sizes, written, F.array(F.lit("2")))))


def is_stuck_in_repetition(text: Column, times: int = REPEATED_LINES) -> Column:
    """Whether the last lines that aren't blank are all equal but for white space at their ends; false with fewer of them."""
    lines = F.filter(F.transform(F.split(text, LINE_END, -1), strip), lambda x: x != "")
    last = F.when(F.size(lines) >= times, F.slice(lines, F.size(lines) - times + 1, times))
    return F.coalesce(F.size(F.array_distinct(last)) == 1, F.lit(False))


def shorten(text: Column, keep: int, mark: str = "... {n} lines omitted ...") -> Column:
    """The first and last lines with a mark of how many are left out; unchanged if that saves nothing."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    before, after = mark.split("{n}")
    omitted = F.concat(F.lit(before), (n - 2 * keep).cast("string"), F.lit(after))
    short = F.array_join(F.concat(F.slice(lines, 1, keep), F.array(omitted), F.slice(lines, F.greatest(n - keep + 1, F.lit(1)), keep)), "\n")
    return F.when(n <= 2 * keep + 1, text).otherwise(short)


#: How many lines are kept at either end, step by step, first of the answers, then of the questions.
KEPT_LINES = (40, 20, 10, 5, 2)
MARKS = {"assistant": "# ... ({n} lines omitted) ...", "user": "... ({n} lines omitted) ..."}


def fit_history(messages: Column, most: int, tokens=token_count) -> Column:
    """struct<messages, fits> of an array of structs role, content, shortened step by step until its tokens are most at most: first the assistant's turns, then the
    user's, each step on what the last one left. fits is false where even the last step leaves too much."""
    total = lambda m: F.aggregate(m, F.lit(0).cast("bigint"), lambda a, x: a + tokens(x["content"]).cast("bigint"))
    steps = F.array(*(F.struct(F.lit(role).alias("role"), F.lit(k).alias("k")) for role in MARKS for k in KEPT_LINES))

    def cut(m, role, keep):
        short = lambda x: F.struct(x["role"].alias("role"), shorten(x["content"], keep, MARKS[role]).alias("content"))
        return F.transform(m, lambda x: F.when(x["role"] == role, short(x)).otherwise(x))

    def step(acc, s):
        out = acc
        for role in MARKS:
            for k in KEPT_LINES:
                out = F.when((s["role"] == role) & (s["k"] == k), cut(acc, role, k)).otherwise(out)
        return F.when(total(acc) <= most, acc).otherwise(out)

    done = F.aggregate(steps, messages, step)
    return F.element_at(F.transform(F.array(done), lambda m: F.struct(m.alias("messages"), (total(m) <= most).alias("fits"))), 1)


def _turned(text: Column, words: tuple[str, ...], turns: int, pattern: str) -> Column:
    """Words become marks of their place and case first, so that none is turned twice."""
    out = text
    for k, word in enumerate(words):
        out = F.regexp_replace(out, pattern.format(f"[{word[0].upper()}](?iu:{word[1:]})"), f"\u0001{k}U")
        out = F.regexp_replace(out, pattern.format(f"[{word[0]}](?iu:{word[1:]})"), f"\u0001{k}L")
    for k in range(4):
        new = words[(k + turns) % 4]
        out = F.replace(F.replace(out, F.lit(f"\u0001{k}U"), F.lit("\u0002" + new.capitalize())), F.lit(f"\u0001{k}L"), F.lit("\u0002" + new))
    return out


def rotate_words(text: Column, turns: int) -> Column:
    """Compass words turned by so many quarters, English words whole and Russian ones by their stems; a capital at the beginning stays, other letters are small."""
    if turns % 4 == 0:
        return text
    out = _turned(text, COMPASS, turns, r"\b{}\b")
    for stems in COMPASS_RU:  # the mark before a turned word keeps the nouns from being found in turned adjectives
        out = _turned(out, stems, turns, r"(?<![а-яё\x02])(?<![А-ЯЁ]){}")
    return F.replace(out, F.lit("\u0002"), F.lit(""))


#: How lines of code begin where no block is fenced, and marks that end an answer.
CODE_STARTS = ("from ", "import ", "#", "bp = ", "def ")
END_MARKS = ("<|eot_id|>", "<|start_header_id|>")


def extract_code(text: Column) -> Column:
    """The longest fenced block; without one, the lines from the first that looks like code up to an end mark; else the whole text."""
    whole = strip(text)
    blocks = F.regexp_extract_all(whole, F.lit(r"(?is)```(?:python)?\s*\n(.*?)```"), F.lit(1))
    longest = F.aggregate(blocks, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    lines = lines_of(whole)
    begins = lambda x: F.exists(F.array(*map(F.lit, CODE_STARTS)), lambda s: F.startswith(F.ltrim(x), s))
    first = F.array_position(F.transform(lines, begins), True)
    rest = F.slice(lines, first.cast("int"), F.size(lines))
    end = F.array_position(F.transform(rest, lambda x: F.exists(F.array(*map(F.lit, END_MARKS)), lambda m: F.contains(x, m))), True)
    code = F.array_join(F.when(end > 1, F.slice(rest, F.lit(1), (end - 1).cast("int"))).otherwise(rest), "\n")
    return F.when(F.size(blocks) > 0, strip(longest)).when(first > 0, strip(code)).otherwise(whole)


@F.pandas_udf(T.StringType())
def syntax_problem(codes: pd.Series) -> pd.Series:
    """Why a script can't be parsed (incomplete or syntax), or null."""

    def problem(code: str | None) -> str | None:
        try:
            ast.parse(code or "")
        except SyntaxError as e:
            return "incomplete" if re.search("unexpected EOF|was never closed|unterminated", str(e)) else "syntax"
        except (ValueError, RecursionError, MemoryError):
            return "syntax"
        return None

    return codes.map(problem)


def code_problem(code: Column) -> Column:
    """The first reason why a script isn't complete, or null."""
    return (
        F.when(strip(F.coalesce(code, F.lit(""))) == "", "empty").when(~F.contains(code, F.lit("Blueprint(")), "no blueprint").when(~F.contains(code, F.lit("to_string()")), "no output")
        .otherwise(syntax_problem(strip(code)))
    )


def packed_version(version: Column) -> Column:
    """major and minor of a 64-bit version."""
    return F.struct(F.shiftright(version, 48).bitwiseAND(65535).cast("int").alias("major"), F.shiftright(version, 32).bitwiseAND(65535).cast("int").alias("minor"))


def tag_version(tags: Column) -> Column:
    """major + minor / 100 of the first tag that has /version/, two numbers with a comma between them, and a slash; or null."""
    pair = "/version/([0-9]+),([0-9]+)/"
    first = F.try_element_at(F.filter(tags, lambda t: t.rlike(pair)), F.lit(1))
    return F.regexp_extract(first, pair, 1).cast("int") + F.regexp_extract(first, pair, 2).cast("int") / 100


def clean_text(text: Column, limit: int = 200) -> Column:
    """One line of printable text: controls and separators become spaces."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{C}\p{Z}]", " "), " +", " ")), 1, limit)


def count_checks(expected: Column, actual: Column) -> Column:
    """exact and within10 of a count against the one expected: off by at most a tenth, or one."""
    off = F.abs(actual - expected)
    return F.struct((off == 0).alias("exact"), (off <= F.greatest(F.lit(1.0), expected * 0.1)).alias("within10"))


def retry_delay(error: Column) -> Column:
    """Seconds that an error text asks to wait, as retryDelay or retry_delay with a value in seconds, or in words; else null."""
    named = F.regexp_extract(error, r"""retry(?:Delay|_delay)['"]?\s*[:=]\s*['"]?([0-9]+(?:\.[0-9]+)?)s""", 1)
    said = F.regexp_extract(error, r"[Rr]etry (?:in|after) ([0-9]+(?:\.[0-9]+)?) ?s", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(said, F.lit(""))).cast("double")


#: Names of directions.
DIRECTIONS = {0: "north", 4: "east", 8: "south", 12: "west"}


def direction_name(direction: Column) -> Column:
    out = direction.cast("string")
    for code, name in DIRECTIONS.items():
        out = F.when(direction == code, name).otherwise(out)
    return out


def resolve_direction(value: Column) -> Column:
    """The code of a direction given by its name, its first letter or its code; null where it is none. An absent one is north."""
    text = F.lower(F.trim(value.cast("string")))
    out = F.when(value.isNull(), 0)
    for code, name in DIRECTIONS.items():
        out = out.when(text.isin(name, name[0], str(code)), code)
    return out


def resolve_tile(x: Column, y: Column) -> Column:
    """struct<x, y> of a place on the grid, or null where a coordinate isn't whole."""
    return F.when((x == F.floor(x)) & (y == F.floor(y)), F.struct(F.floor(x).cast("int").alias("x"), F.floor(y).cast("int").alias("y")))


def close_names(known: list[str], most: int = 3):
    """A function of a column of names: the most similar known names, the nearest first; none for a known name."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def similar(names: pd.Series) -> pd.Series:
        return names.map(lambda n: [] if n is None or n in known else difflib.get_close_matches(n, known, n=most))

    return similar


def natural_names(names: list[str]):
    """A function of a column: white space collapsed, and known names with hyphens (an s behind them or not) written with spaces."""
    wanted = re.compile(r"\b(" + "|".join(sorted(map(re.escape, names), key=len, reverse=True)) + r")(s?)\b") if names else None

    @F.pandas_udf(T.StringType())
    def natural(prompts: pd.Series) -> pd.Series:
        flat = prompts.map(lambda p: None if p is None else " ".join(p.split()))
        return flat if wanted is None else flat.map(lambda p: p and wanted.sub(lambda m: m[1].replace("-", " ") + m[2], p))

    return natural


#: The template of a model, by parts of its name, in order.
TEMPLATES = (("qwen", "qwen"), ("llama-3", "llama3"), ("llama3", "llama3"), ("mistral", "mistral"), ("gemma", "gemma"))


def model_template(name: Column, parts: tuple[tuple[str, str], ...] = TEMPLATES) -> Column:
    """The chat template of a model by the first part that its name has, or null."""
    out = F.lit(None).cast("string")
    for part, template in reversed(parts):
        out = F.when(F.contains(F.lower(name), F.lit(part)), template).otherwise(out)
    return out


def run_feedback(success: Column, error: Column, stdout: Column, stderr: Column) -> Column:
    """What is said of a failed run: its error, and the last 25 lines of stderr, or else the first 1,000 characters of stdout; empty for a success."""
    said = lambda c: F.coalesce(strip(c), F.lit(""))
    lines = lines_of(said(stderr))
    tail = F.array_join(F.slice(lines, F.greatest(F.size(lines) - 24, F.lit(1)), F.lit(25)), "\n")
    fenced = lambda title, body: F.concat(F.lit(f"{title}:\n```\n"), body, F.lit("\n```"))
    shown = F.when(said(stderr) != "", fenced("Traceback / Stderr", tail)).when(said(stdout) != "", fenced("Stdout", F.substring(said(stdout), 1, 1000)))
    parts = F.filter(F.array(F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("Error summary: "), error)), shown), lambda x: x.isNotNull())
    return F.when(success, "").otherwise(F.array_join(parts, "\n\n"))


def layout_in_output(stdout: Column) -> Column:
    """The first encoded layout in a script's output: '0e' and more of base64, 20 characters or more; null without one."""
    return F.nullif(F.regexp_extract(stdout, "(0e[A-Za-z0-9+/=]{18,})", 1), F.lit(""))


def favorites_of(raw: Column) -> Column:
    """The number of favourites of a row's JSON: an object counts its members, a number is itself, anything else is 0."""
    value = F.coalesce(F.get_json_object(raw, "$.favorites"), F.get_json_object(raw, "$.numberOfFavorites"))
    members = F.size(F.map_keys(F.from_json(value, "map<string,string>")))
    return F.when(F.startswith(value, F.lit("{")), F.coalesce(members, F.lit(0))).otherwise(F.coalesce(value.try_cast("int"), F.lit(0)))


def is_vanilla(tags: Column) -> Column:
    """Whether no tag names another mod than vanilla or another planet than nauvis."""
    return ~F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: (F.startswith(t, F.lit("/mods/")) & (t != "/mods/vanilla/")) | (F.startswith(t, F.lit("/planets/")) & (t != "/planets/nauvis/")))


#: Words that players use for entities, as patterns in English and Russian, and the entities that they mean.
ENTITY_WORDS = (
    (r"stone furnace|каменн\w* печ", "stone-furnace"), (r"steel furnace|стальн\w* печ", "steel-furnace"), (r"electric furnace|электр\w* печ|электропеч", "electric-furnace"),
    (r"furnace|печ", "stone-furnace steel-furnace electric-furnace"), (r"long[- ]handed inserter|длинн\w* манипулятор", "long-handed-inserter"), (r"fast inserter|быстр\w* манипулятор", "fast-inserter"),
    (r"bulk inserter|stack inserter|объемн\w* манипулятор|объёмн\w* манипулятор", "bulk-inserter"), (r"inserter|манипулятор", "burner-inserter inserter long-handed-inserter fast-inserter bulk-inserter"),
    (r"\blabs?\b|лаборатор|\bлаб", "lab"), (r"solar panel|солнечн\w* панел", "solar-panel"), (r"accumulator|аккумулятор", "accumulator"), (r"boiler|котл|котёл|котел", "boiler"),
    (r"steam engine|паров\w* двигател|паров\w* машин", "steam-engine"), (r"steam turbine|паров\w* турбин|турбин", "steam-turbine"), (r"beacon|маяк", "beacon"), (r"nuclear reactor|ядерн\w* реактор|реактор", "nuclear-reactor"),
    (r"roboport|робопорт|дронстанц", "roboport"), (r"assembl|сборочн|собирающ|сборщик|ассемблер", "assembling-machine-1 assembling-machine-2 assembling-machine-3"),
    (r"mining drill|\bdrills?\b|бур", "electric-mining-drill burner-mining-drill"), (r"chemical plant|химическ\w* завод|химзавод", "chemical-plant"), (r"refiner|нефтеперераб", "oil-refinery"), (r"pumpjack|качалк", "pumpjack"),
    (r"flamethrower|огнем[её]т", "flamethrower-turret"), (r"laser|лазерн", "laser-turret"), (r"turret|турел", "gun-turret laser-turret flamethrower-turret artillery-turret"), (r"\bwalls?\b|стен", "stone-wall"),
    (r"\blamps?\b|ламп|фонар", "small-lamp"), (r"centrifuge|центрифуг", "centrifuge"), (r"splitter|разделител|делител|сплиттер", "splitter fast-splitter express-splitter"), (r"substation|подстанц", "substation"), (r"radar|радар", "radar"),
    (r"chest|сундук|ящик", "wooden-chest iron-chest steel-chest active-provider-chest passive-provider-chest storage-chest buffer-chest requester-chest"),
    (r"underground|подземн", "underground-belt fast-underground-belt express-underground-belt pipe-to-ground"), (r"\bbelts?\b|конвейер|лент", "transport-belt fast-transport-belt express-transport-belt"),
    (r"\bpoles?\b|столб|опор", "small-electric-pole medium-electric-pole big-electric-pole"),
)
#: What makes a number a size, a ratio, a tier or a measure rather than a count; lanes of a belt request.
JOINS, TIERS = r"(?:x|by|на|×|to|-|в|к|:|\+)", r"(?:level|tier|mk|уровн\w*|тир|machines?|assemblers?|автомат\w*|завод\w*|машин\w*|сборщик\w*)"
UNITS = r"(?:degrees?|°|[kmg]w\b|[кмг]вт|inputs?|outputs?|lanes?|полос|вход|выход|spm|i/s|items?/)"
BELT_LANES = 8
CLAIM = r"(?<![\w.\-])(\d+)(?![\d.,]\d)\s+([^\d,.;:!?]{2,40})"

CONFLICT = T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("tail", T.StringType()), T.StructField("present", T.MapType(T.StringType(), T.IntegerType()))]))


def conflicts_in(prompt: str, counts: dict[str, int], recipes: set[int]) -> list[tuple[int, str, dict[str, int]]]:
    """(number, words behind it, what the layout has) of each claim of a number of entities that the layout contradicts."""
    text, out = prompt.lower(), []
    words = [(re.compile(p), names.split()) for p, names in ENTITY_WORDS]
    for claim in re.finditer(CLAIM, text):
        before, tail, n = text[: claim.start()], claim[2], int(claim[1])
        if re.search(rf"(?:\d+\s*{JOINS}|{TIERS})\s*$", before) or re.match(rf"(?:{JOINS}\s*\d|{UNITS})", tail):
            continue
        near = " ".join(tail.split()[:3])
        hits = [(m.start(), -len(m[0]), i) for i, (p, _) in enumerate(words) if (m := p.search(near))]
        if not hits:
            continue
        names = words[min(hits)[2]][1]
        present = {k: counts[k] for k in names if counts.get(k) is not None}
        machines, belts = (all(part in k for k in names) for part in ("assembling-machine", "transport-belt"))
        if not (present and (n in {sum(present.values()), *present.values()} or (machines and n in recipes) or (belts and n <= BELT_LANES))):
            out.append((n, tail.strip()[:30], present))
    return out


@F.pandas_udf(CONFLICT)
def count_conflicts(prompts: pd.Series, counts: pd.Series, recipes: pd.Series) -> pd.Series:
    """The claims of a prompt that its layout's counts (maps of name to count) contradict."""

    def work(prompt, have, made):
        have, made = dict(have if have is not None else {}), dict(made if made is not None else {})
        return [{"n": n, "tail": tail, "present": present} for n, tail, present in conflicts_in(prompt or "", have, set(made.values()))]

    return pd.Series([work(*row) for row in zip(prompts, counts, recipes, strict=True)])
