"""Text functions as columns: normalisers, anchors, magnitudes, legibility, salvage of JSON. No Python runs in any of them
but indel_ratio, whose definition built-in functions can't express."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Units whose letters may be of either case, and one-letter units, which may not.
MULTI_UNITS = r"m/s|VCA|VCC|VAC|VDC|kWh|kW|kHz|mA|HP|Hz|rpm|mm|cm|kg|°C|N-m|Nm|seg(?:undos)?|minutos"
SINGLE_UNITS = r"A|V|W|%|m|g|h|s"
CODE = r"\b[A-Za-z]{1,2}\d{1,3}(?:\(\d+\))?\b"

# Words without content.
STOPWORDS = (
    "el la los las un una unos unas de del al a en y o que se por para con sin su sus lo es son como más pero si no ya le les esta este esto esa ese eso hay ser está están the of and to in for"
).split()

# Units of magnitudes on figures.
MAGNITUDE_UNITS = r"kV|kW|mA|Vca|Vcc|Vac|Vdc|RPM|rpm|Nm|bar|HP|Hz|°C|Ω|V|A|W"
NUMBERS = r"\d+(?:[.,]\d+)?(?:\s*/\s*\d+(?:[.,]\d+)?)*"
MAGNITUDE = rf"(\b(?:{MAGNITUDE_UNITS}))\s*({NUMBERS})|({NUMBERS})\s*((?:{MAGNITUDE_UNITS})\b)"

# Decimal numbers as DuckDB casts them.
DIGITS = r"[0-9]+(?:_[0-9]+)*"
DECIMAL = rf"\A[+-]?(?=\.?[0-9])(?:{DIGITS})?(?:\.(?:{DIGITS})?)?(?:[eE][+-]?{DIGITS})?[\t-\r ]*\z"

# Patterns of electrical components and values.
COMPONENT_PATTERNS = {
    "motor": r"\bmotor\b|\bM\d+\b",
    "contactor": r"\bcontactor\b|\bK\d+\b",
    "relay": r"\brelay\b|\bKA?\d+\b",
    "fuse": r"\bfuse\b|\bF\d+\b",
    "breaker": r"\bbreaker\b|\bQF?\d+\b",
    "transformer": r"\btransformer\b|\bT\d+\b",
    "terminal": r"\bterminal\b|\bX\d+\b",
    "sensor": r"\bsensor\b|\bB\d+\b",
    "switch": r"\bswitch\b|\bS\d+\b",
}
VALUE_PATTERNS = {
    "voltage": r"\d+\.?\d*\s*[Vv](AC|DC)?",
    "current": r"\d+\.?\d*\s*[Aa]",
    "power": r"\d+\.?\d*\s*(kW|W|HP|hp)",
    "frequency": r"\d+\.?\d*\s*[Hh]z",
    "resistance": r"\d+\.?\d*\s*[Ωω]",
}


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def unaccented(text: Column) -> Column:
    """Lower case, compatible characters decomposed (NFKD) and marks left out. Characters that decompose to one are translated, those
    that decompose to several replaced where a text has any."""
    one, many, none = decompositions()
    low = F.translate(F.lower(text), "".join(one) + none, "".join(one.values()))
    mapping = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in many.items())), F.lit("\x01"), F.lit("\x02"))
    spelt = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(mapping, c), c)), "")
    return F.when(F.translate(low, "".join(many), "") != low, spelt).otherwise(low)


@cache
def decompositions() -> tuple[dict[str, str], dict[str, str], str]:
    """Of the characters of the first plane but Hangul syllables, by what is left of their decomposition without marks: those that leave
    one other character, those that leave several, and those that leave none."""
    one, many, none = {}, {}, ""
    for c in map(chr, (*range(0x80, 0xAC00), *range(0xE000, 0x10000))):
        left = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if not left:
            none += c
        elif left != c == c.lower():
            (one if len(left) == 1 else many)[c] = left
    return one, many, none


def normalised_question(text: Column) -> Column:
    """Key of a question: lower case, without marks, anything but word characters as one space (O-142)."""
    return squeezed(F.regexp_replace(unaccented(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]+", " "))


def normalised_answer(text: Column) -> Column:
    """Lower case, without marks, decimal commas as points, white space as one space (O-143)."""
    return squeezed(F.regexp_replace(unaccented(F.coalesce(text, F.lit(""))), r"(?<=\d),(?=\d)", "."))


def anchors(key: Column) -> Column:
    """Codes, values with units, and specific numbers of these, normalised and without spaces, sorted (O-144)."""
    key = F.coalesce(key, F.lit(""))
    values = F.concat(extract_all(key, rf"(?i)\b\d+(?:[.,]\d+)?\s*(?:{MULTI_UNITS})"), extract_all(key, rf"\b\d+(?:[.,]\d+)?\s*(?:{SINGLE_UNITS})\b"))
    numbers = F.transform(values, lambda v: F.regexp_replace(F.regexp_extract(v, r"^\d+(?:[.,]\d+)?", 0), ",", "."))
    specific = F.filter(numbers, lambda n: n.contains(".") | (F.length(n) >= 3))
    found = F.transform(F.concat(extract_all(key, CODE), values), lambda a: F.replace(normalised_answer(a), F.lit(" "), F.lit("")))
    return F.array_sort(F.array_distinct(F.concat(found, specific)))


def content_words(text: Column) -> Column:
    """Words of three letters or more that are not stopwords, in order (O-145)."""
    words = extract_all(normalised_answer(text), "[a-z0-9áéíóúñ]{3,}")
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def verifiable(key: Column, least: int = 2) -> Column:
    return (F.size(anchors(key)) > 0) | (F.size(content_words(key)) >= least)


def answer_present(key: Column, texts: Column, least: float = 0.6) -> Column:
    """Whether an answer stands in the texts (an array): an anchor without spaces, else a share of its content words; null
    where the key can't be verified (O-145)."""
    joined = normalised_answer(F.array_join(texts, " \n "))
    a, w = anchors(key), content_words(key)

    def judged(t: Column) -> Column:
        """With the joined texts bound to a variable, so that they are normalised once and not for each word."""
        tight = F.replace(t, F.lit(" "), F.lit(""))
        by_words = F.try_divide(F.size(F.filter(w, lambda x: F.contains(t, x))), F.size(w)) >= least
        return F.when(F.size(a) > 0, F.exists(a, lambda x: F.contains(tight, x))).otherwise(by_words)

    return F.when(verifiable(key), F.transform(F.array(joined), judged)[0])


def legible_run(text: Column) -> Column:
    """The most words of four letters or more in a run of alphabetic tokens (O-56)."""
    tokens = F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: F.regexp_replace(t, "^[.,;:()\\[\\]\"'“”|—-]+|[.,;:()\\[\\]\"'“”|—-]+$", ""))
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, t: Column) -> Column:
        run = F.when(t.rlike("^[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+$"), s["run"] + (F.length(t) >= 4).cast("int")).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(tokens, zero, step, lambda s: s["best"])


def legible(text: Column) -> Column:
    return legible_run(text) >= 2


def components(text: Column) -> Column:
    """kind:match of the electrical components named in a text, sorted (O-57)."""
    low = F.lower(text)
    named = lambda kind, pattern: F.transform(extract_all(low, "(?i)" + pattern), lambda m: F.concat(F.lit(kind + ":"), m))
    return F.array_sort(F.array_distinct(F.concat(*[named(k, p) for k, p in COMPONENT_PATTERNS.items()])))


def electrical_values(text: Column) -> Column:
    """Map of kind to the values in reading order, each once; kinds without values are left out (O-57). As its patterns
    have at most one group, a value of a pattern with a group is that group's match."""
    entries = [F.struct(F.lit(k).alias("key"), F.array_distinct(extract_all(text, "(?i)" + p, 1 if "(" in p else 0)).alias("value")) for k, p in VALUE_PATTERNS.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))


def magnitudes(text: Column) -> Column:
    """Values with units, a pair with a slash as two, sorted (O-58): one pattern of two branches, so none is paired twice."""
    text = F.coalesce(text, F.lit(""))
    groups = [extract_all(text, MAGNITUDE, g) for g in range(1, 5)]
    units = F.zip_with(groups[0], groups[3], lambda a, b: F.concat(a, b))
    numbers = F.zip_with(groups[1], groups[2], lambda a, b: F.concat(a, b))
    each = F.zip_with(units, numbers, lambda u, n: F.transform(F.split(n, "/"), lambda x: F.concat(F.replace(F.trim(x), F.lit(","), F.lit(".")), u)))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def unsupported(value: Column, transcript: Column) -> Column:
    """Whether any number of a value is missing in the transcript without spaces (O-59)."""
    tight = F.regexp_replace(F.lower(transcript), r"\s+", "")
    return F.exists(extract_all(value, r"\d+(?:[.,]\d+)?"), lambda n: ~F.contains(tight, F.replace(n, F.lit(","), F.lit("."))))


def disputed(a: Column, b: Column) -> Column:
    """Magnitudes that only one of two readings has, sorted (O-60)."""
    x, y = magnitudes(a), magnitudes(b)
    return F.array_sort(F.concat(F.array_except(x, y), F.array_except(y, x)))


def char_grams(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams of a text in lower case without anything but letters and digits (O-151). One scan of the text:
    matches of nothing that look ahead for n characters."""
    t = F.regexp_replace(unaccented(text), r"[^a-z0-9]+", "")
    return F.array_distinct(extract_all(t, rf"(?=(.{{{n}}}))", 1))


def sanitised(text: Column) -> Column:
    """Escapes &, <, > and double quotes (O-68)."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def salvaged_json(text: Column) -> Column:
    """The JSON object or array of a model's answer as text: without fences, else from the first bracket to the last; null
    where neither parses (O-148)."""
    t = F.trim(text)
    bare = F.regexp_replace(F.regexp_replace(t, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    t = F.when(t.startswith("```"), bare).otherwise(t)
    parsed = lambda c: F.to_json(F.try_parse_json(F.when(F.length(c) > 0, c)))
    return F.coalesce(parsed(t), parsed(F.regexp_extract(t, r"(?s)\{.*\}", 0)), parsed(F.regexp_extract(t, r"(?s)\[.*\]", 0)))


def estimated_tokens(text: Column) -> Column:
    """Stand-in of a tokenizer: a token for four characters, rounded up (O-152)."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def whole_number(text: Column) -> Column:
    """A text as an INT, as DuckDB casts it: decimals and exponents too, rounded half away from zero, 0x and 0b, single _ between
    digits, only ASCII white space around; null for all else and beyond 32 bits (O-149). Exact for texts of three characters; of
    longer ones a dot after an exponent and a zero with an exponent beyond 37 are null here, and 18 places after the point are kept."""
    t = F.regexp_replace(text, r"\A[\t-\r ]+", "")
    bare = F.replace(t, F.lit("_"), F.lit(""))
    based = lambda digit, most, base: F.conv(F.regexp_extract(bare, rf"\A0[a-zA-Z]0*({digit}{{1,{most}}})\z", 1), base, 10)
    number = F.when(t.rlike(DECIMAL), F.round(bare.try_cast("decimal(38,18)"))).try_cast("int")
    hexadecimal = F.when(t.rlike(r"\A0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*\z"), based("[0-9a-fA-F]", 8, 16)).try_cast("int")
    return F.coalesce(number, hexadecimal, F.when(t.rlike(r"\A0[bB][01]+(?:_[01]+)*\z"), based("[01]", 31, 2)).try_cast("int"))


def cleaned_answer(text: Column) -> Column:
    """An answer without its leading label and without label lines (O-147)."""
    labelled = F.lower(text).rlike(r"^\n*(?:a\d?:*\.*|answer\d?:*\.*)")
    rest = F.regexp_replace(text, r"(?s)^[^ ]* ?", "")
    t = F.when(labelled, rest).otherwise(text)
    return F.trim(F.regexp_replace(t, r"\n*\s*#{0,3}\n*\s*A:+", ""))


def linked_urls(text: Column) -> Column:
    """Addresses as links named by the words of their domain without the last (O-147)."""
    urls = F.array_distinct(F.transform(extract_all(text, r"https?://[^\s()]+"), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))
    name = lambda u: F.initcap(F.replace(F.regexp_extract(u, r"^https?://([^/]*)\.[^./]+(?:/|$)", 1), F.lit("."), F.lit(" ")))
    return F.aggregate(urls, text, lambda t, u: F.replace(t, u, F.concat(F.lit("["), name(u), F.lit("]("), u, F.lit(")"))))


def _indel(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths; 100 for two empty strings."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = where.get(c, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def indel_ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Similarity in per cent of two strings by insertions and deletions, without quotes, commas and points, in lower case (O-146)."""
    drop = str.maketrans("", "", "\"'.,")
    for a, b in parts:
        yield pd.Series([_indel((x or "").translate(drop).lower(), (y or "").translate(drop).lower()) for x, y in zip(a, b, strict=True)], dtype="float64")


def relabelled(text: Column, old: str, new: str) -> Column:
    """A text with its first line that begins with the old label under the new one; a text that has the new one stays (O-150)."""
    done = text.rlike(rf"(?m)^\Q{new}\E")
    return F.when(done, text).otherwise(F.regexp_replace(text, rf"(?s)\A(.*?)(?m:^)\Q{old}\E", "$1" + new))
