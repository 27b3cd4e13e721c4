"""Column functions on text: cleaning, normal forms, search terms, line tests. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V

#: White space as Python's str.split() sees it; usable in Java and RE2.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: The same for Java only: printable ASCII, most of all text, is refused by its first test.
_WS, _END = f"[[^!-~]&&{WS}]", LINE_END.replace("[", "[[^ -~]&&[") + "]"
#: White space runs that aren't one plain space already.
_RUN = f"[[^ -~]&&{WS}]{_WS}*| {_WS}+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words_in(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def squeeze(c: Column | str) -> Column:
    """White space runs become one space; none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), _RUN, " "))


def clean_lines(c: Column | str) -> Column:
    """Array of squeezed, non-empty lines."""
    lines = F.split(F.regexp_replace(F.coalesce(_c(c), F.lit("")), "\\x00", " "), _END)
    return F.filter(F.transform(lines, squeeze), lambda x: x != "")


def clean_text(c: Column | str) -> Column:
    return F.array_join(clean_lines(c), "\n")


def normal_name(c: Column | str) -> Column:
    """Lower case, everything but letters and digits of ASCII to single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), "[^a-z0-9]+", " "))


def normal_search(c: Column | str) -> Column:
    """Commas out, digits separated by white space joined, squeezed."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.coalesce(_c(c), F.lit("")), ",", ""), rf"(?<=\d){_WS}+(?=\d)", ""))


def variants(t: Column) -> Column:
    """Other spellings of a token: its parts at / - . apart and joined, and its digits and dots."""
    none = F.array().cast("array<string>")
    parts = F.filter(F.split(t, "[/.-]+"), lambda x: x != "")
    split = F.when(t.rlike("[/-]") & (F.size(parts) > 1), F.array(F.array_join(parts, " "), F.array_join(parts, ""))).otherwise(none)
    digits = F.regexp_replace(t, "[^0-9.]", "")
    return F.concat(split, F.when((digits != "") & (digits != t) & t.rlike(r"\d"), F.array(digits)).otherwise(none))


def tokens(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit("[a-z0-9./-]+"), F.lit(0))


def search_text(c: Column | str) -> Column:
    """Lower normal form followed by the distinct variants of its tokens."""
    n = F.lower(normal_search(c))
    extra = F.filter(F.array_distinct(F.flatten(F.transform(tokens(n), variants))), lambda x: x != "")
    return F.when(n == "", F.lit("")).otherwise(F.concat_ws(" ", n, F.array_except(extra, F.array(n))))


def search_terms(c: Column | str) -> Column:
    """Distinct search terms in order: tokens that are no stop words and have 3 characters or a digit, each followed by such variants."""
    fits = lambda x: (F.length(x) >= 3) | x.rlike(r"\d")
    kept = F.filter(tokens(F.lower(normal_search(c))), lambda x: ~x.isin(V.SEARCH_STOP) & fits(x))
    return F.array_distinct(F.flatten(F.transform(kept, lambda x: F.concat(F.array(x), F.filter(variants(x), fits)))))


def numeric(terms: Column) -> Column:
    return F.filter(terms, lambda x: x.rlike(r"\d"))


def textual(terms: Column) -> Column:
    return F.filter(terms, lambda x: ~x.rlike(r"\d"))


def snippet(c: Column | str, limit: int = 260) -> Column:
    s = squeeze(c)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit - 3)), F.lit("...")))


def contains_any(c: Column, phrases: list[str]) -> Column:
    return F.exists(words_in(phrases), lambda p: F.contains(c, p))


def matches(haystack: Column, terms: Column) -> Column:
    """Number of terms that occur in haystack."""
    return F.size(F.filter(terms, lambda t: F.contains(haystack, t)))


def word_count(squeezed: Column) -> Column:
    return F.when(squeezed == "", 0).otherwise(F.size(F.split(squeezed, " ")))


def is_heading(line: Column) -> Column:
    """line: squeezed and not empty."""
    bare = F.regexp_replace(F.lower(line), "^:+|:+$", "")
    short = word_count(line) <= 6
    return bare.isin(V.HEADINGS) | ((F.upper(line) == line) & (F.lower(line) != line) & short) | (line.endswith(":") & short)


def has_number(c: Column) -> Column:
    return c.rlike(r"\d")


def has_decimal(c: Column) -> Column:
    return c.rlike(r"\d+\.\d+")


def number_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\d+(?:\.\d+)?"))


def is_text_rich(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z]")) >= 5


def is_row_section(section: Column) -> Column:
    return contains_any(normal_name(section), V.ROW_SECTIONS)


def looks_like_label(label: Column) -> Column:
    """label: normal name."""
    return (label != "") & ~label.isin(V.SKIP_LABELS) & (word_count(label) <= 6) & ~has_number(label)


def is_table_header(line: Column) -> Column:
    t = F.split(normal_name(line), " ")
    hits = F.size(F.filter(t, lambda x: x.isin(V.TABLE_HEADER)))
    return (F.size(t) >= 4) & (hits >= 4) & (hits * 2 >= F.size(t))


def cells(line: Column) -> Column:
    """Cells at |, else tabs, else runs of two or more white spaces; empty ones dropped."""
    line = F.regexp_replace(line, f"^{WS}+|{WS}+$", "")
    raw = F.when(F.contains(line, F.lit("|")), F.split(line, r"\|")).when(F.contains(line, F.lit("\t")), F.split(line, "\t")).otherwise(F.split(line, WS + "{2,}"))
    return F.filter(F.transform(raw, lambda x: F.regexp_replace(x, f"^{WS}+|{WS}+$", "")), lambda x: x != "")


def is_stop_line(line: Column) -> Column:
    n = normal_name(line)
    return (n == "") | F.exists(words_in(V.ITEM_STOPS), lambda w: F.startswith(n, w))


def context_boost(normal_snippet: Column, two: float, one: float, stop: float, none: float) -> Column:
    """By the words before the first digit that aren't context stop words: two or more, one, only stop words, no words."""
    words = F.regexp_extract_all(F.lower(F.split(normal_snippet, r"\d", 2)[0]), F.lit("[a-z]+"), F.lit(0))
    good = F.size(F.filter(words, lambda w: ~w.isin(V.ROW_CONTEXT_STOP)))
    return F.when(good >= 2, two).when(good == 1, one).when(F.size(words) > 0, stop).otherwise(none)


def specificity(normal_snippet: Column) -> Column:
    penalty = F.when(F.contains(normal_snippet, F.lit("material code description")), -1.0).otherwise(0.0) + F.when(F.contains(normal_snippet, F.lit("process route")), -0.6).otherwise(0.0)
    return penalty - F.length(normal_snippet) / 1000.0


def first_group(c: Column, patterns: list[str], flags: str = "(?i)") -> Column:
    """Group 1 of the first pattern that matches anywhere; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, flags + p, 1), F.lit("")) for p in patterns])


def confidence(score: Column, sources: Column) -> Column:
    """struct(score, label)."""
    exact = F.array_contains(sources, "exact")
    label = F.when(exact | (score >= 0.9), "high").when(score >= 0.55, "medium").otherwise("low")
    return F.struct(F.when(exact, 1.0).otherwise(F.round(score, 4)).alias("score"), label.alias("label"))


def match_reasons(sources: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in V.REASONS.items() for x in kv])
    return F.filter(F.transform(sources, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull())


def json_ready(*columns: Column) -> Column:
    """JSON of a row: decimals as numbers, dates as ISO text, nested values likewise; nulls are kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def hash_slots(c: Column | str, size: int) -> Column:
    """array(struct(slot, sign)) of the tokens of a text for a hashed embedding: first 4 bytes of SHA-1, sign by the fifth."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))

    def one(t):
        h = F.sha1(t)
        slot = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % size
        return F.struct(slot.cast("int").alias("slot"), F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))

    return F.transform(toks, one)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    sq = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    norm = sq(a) * sq(b)
    return F.when(norm > 0, dot / norm).otherwise(0.0)
