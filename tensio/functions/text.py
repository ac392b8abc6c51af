"""Column expressions for text: cleaning, dictionary matching, scoring, tokenising.

All of these are built-in Spark expressions, so they stay inside whole-stage codegen.
The regular expressions are written so that Java's engine (Spark) and RE2 (DuckDB, used
as the oracle) give the same answers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from tensio.functions.lexicons import KERAS_FILTERS, NA_TOKENS, ScoreProfile
from tensio.functions.numeric import round_places

# Python's str.split() / regex \s are Unicode-aware; Java's \s is ASCII-only.  These are
# the characters Python treats as whitespace (derived by rule, not listed by hand).
WS_CHARS = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())
# The same set as a regex class body, as written for RE2 (used by the SQL oracle).
WS = r"\t-\r\x{1c}- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
URL_RE = rf"(?:http|www)[^{WS}]+"
NON_LETTER_RE = rf"[^a-z{WS}]"
WS_RUN_RE = rf"[{WS}]+"
# Java's engine is an order of magnitude slower on that Unicode class than on ASCII, so the
# Spark side first maps every whitespace character to a plain space with ``translate`` and
# then uses ASCII-only patterns; the result is the same string.
_NON_SPACE_WS = WS_CHARS.replace(" ", "")
_URL_ASCII_RE = r"(?:http|www)[^ ]+"
_NON_LETTER_ASCII_RE = r"[^a-z ]+"
_SPACE_RUN_RE = r" {2,}"
# Python's \w on str patterns: letters, numbers and the underscore.
WORD_RE = r"[\p{L}\p{N}_]+"


def _col(c: Column | str) -> Column:
    """A column by its exact top-level name (dots and spaces allowed), or the Column itself."""
    return F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c


def lowercase(c: Column | str) -> Column:
    return F.lower(_col(c))


def strip_urls(c: Column | str) -> Column:
    """Remove ``http…`` / ``www…`` runs up to the next whitespace (no word boundary)."""
    return F.regexp_replace(_col(c), URL_RE, "")


def keep_letters(c: Column | str) -> Column:
    """Drop everything but ``a-z`` and whitespace, without inserting spaces."""
    return F.regexp_replace(_col(c), NON_LETTER_RE, "")


def squeeze_spaces(c: Column | str) -> Column:
    """Collapse whitespace runs to one space and trim the ends."""
    return F.trim(F.regexp_replace(_col(c), WS_RUN_RE, " "))


def spaces_only(c: Column | str) -> Column:
    """Every Unicode whitespace character becomes a plain space."""
    return F.translate(_col(c), _NON_SPACE_WS, " " * len(_NON_SPACE_WS))


def clean_text(c: Column | str) -> Column:
    """lower → strip URLs → keep letters/space → squeeze spaces; NULL becomes ``''``.

    Equal to the Unicode-class recipe (``URL_RE``, ``NON_LETTER_RE``, ``WS_RUN_RE``, trim)
    on every input; see the module comment on why it is phrased with ``translate``.
    """
    x = spaces_only(F.lower(F.coalesce(_col(c), F.lit(""))))
    x = F.regexp_replace(x, _URL_ASCII_RE, "")
    x = F.regexp_replace(x, _NON_LETTER_ASCII_RE, "")
    return F.trim(F.regexp_replace(x, _SPACE_RUN_RE, " "))


def term_hits(c: Column | str, terms: Sequence[str]) -> list[Column]:
    """One boolean per term: does the term occur as a substring."""
    t = _col(c)
    return [t.contains(term) for term in terms]


def found_terms(c: Column | str, terms: Sequence[str]) -> Column:
    """Matching terms in dictionary order joined by ``', '``; ``'none'`` when there are none."""
    t = _col(c)
    joined = F.concat_ws(", ", *[F.when(t.contains(term), F.lit(term)) for term in terms])
    return F.when(joined == "", F.lit("none")).otherwise(joined)


def matched_terms(c: Column | str, terms: Sequence[str]) -> Column:
    """Array of matching terms in dictionary order."""
    t = _col(c)
    return F.array_compact(F.array(*[F.when(t.contains(term), F.lit(term)) for term in terms]))


def term_count(c: Column | str, terms: Sequence[str]) -> Column:
    """Number of distinct dictionary terms found (each term counts once)."""
    hits = [h.cast("int") for h in term_hits(c, terms)]
    if not hits:
        return F.lit(0)
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total


def count_from_found(found: Column | str) -> Column:
    """Term count recovered from a joined found-terms string."""
    f = _col(found)
    return F.when(f == "none", F.lit(0)).otherwise(F.size(F.split(f, ", ")))


def relevance_from_counts(counts: Mapping[str, Column], profile: ScoreProfile) -> Column:
    """Σ min(n_f / saturation, 1) · w_f, rounded; families with weight 0 are skipped.

    With a whole-number saturation every family has only ``saturation + 1`` different parts, so
    all scores are worked out once and a row looks up its own.
    """
    weighted = [(f, w) for f, w in profile.weights.items() if w != 0]
    steps = int(profile.saturation)
    if steps == profile.saturation and 0 < steps and (steps + 1) ** len(weighted) <= 4096:
        scores = []
        for parts in product(range(steps + 1), repeat=len(weighted)):
            total = 0.0
            for n, (_, w) in zip(parts, weighted, strict=True):
                total += min(n / profile.saturation, 1.0) * float(w)
            scores.append(round(total, profile.digits))
        place = F.lit(0)
        for f, _ in weighted:
            place = place * (steps + 1) + F.least(counts[f].cast("int"), F.lit(steps))
        return F.get(F.array(*[F.lit(v) for v in scores]), place)
    total = F.lit(0.0)
    for f, w in weighted:
        total = total + F.least(counts[f].cast("double") / F.lit(profile.saturation), F.lit(1.0)) * F.lit(float(w))
    return round_places(total, profile.digits)


def relevance_score(c: Column | str, profile: ScoreProfile) -> Column:
    """Relevance score of an already cleaned text; empty text scores 0."""
    t = _col(c)
    counts = {f: term_count(t, profile.families[f]) for f in profile.weights}
    return F.when(t == "", F.lit(0.0)).otherwise(relevance_from_counts(counts, profile))


def tokenize_words(c: Column | str) -> Column:
    """Lowercase word tokens (Unicode letters, digits, underscore), repeats and order kept."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD_RE), 0)


def _keras_filter_class() -> str:
    specials = set("\\^-[]")
    out = []
    for ch in KERAS_FILTERS:
        if ch == "\t":
            out.append(r"\t")
        elif ch == "\n":
            out.append(r"\n")
        elif ch in specials:
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "[" + "".join(out) + "]"


KERAS_FILTER_RE = _keras_filter_class()


def keras_tokens(c: Column | str) -> Column:
    """Tokens as a Keras-style tokenizer sees them: lower, filter characters → space, split on space."""
    spaced = F.regexp_replace(F.lower(_col(c)), KERAS_FILTER_RE, " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def space_tokens(c: Column | str) -> Column:
    """Tokens of a cleaned text (single spaces, no edge spaces)."""
    t = _col(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def na_to_null(c: Column | str, tokens: Sequence[str] = NA_TOKENS) -> Column:
    """Whole-value missing tokens (``NA``, ``null``, ``''``, …) become NULL; ``none`` stays."""
    x = _col(c)
    return F.when(x.isin(list(tokens)), F.lit(None).cast("string")).otherwise(x)


def sentinel_replace(c: Column | str, sentinel: str, replacement: str = "") -> Column:
    """Replace a whole-value sentinel."""
    x = _col(c)
    return F.when(x == sentinel, F.lit(replacement)).otherwise(x)


def value_map(c: Column | str, mapping: Mapping[int, int]) -> Column:
    """Map listed values, everything else (and NULL) to NULL."""
    x = _col(c)
    out = None
    for k, v in mapping.items():
        out = F.when(x == k, F.lit(v)) if out is None else out.when(x == k, F.lit(v))
    return out if out is not None else F.lit(None)


#: A decimal number as text: no type suffix, no hexadecimal digits.
NUMBER_RE = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


def coerce_numeric(c: Column | str) -> Column:
    """Parse as a double; text that is not a decimal number (and NaN) becomes NULL."""
    t = F.trim(_col(c).cast("string"))
    v = F.when(t.rlike(NUMBER_RE), t).try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


# `Tue Apr 07 06:29:03 PDT 2009`: drop the weekday, parse the rest.
POST_TIME_FORMAT = "MMM dd HH:mm:ss zzz yyyy"
POST_TIME_OFFSET_FORMAT = "MMM dd HH:mm:ss Z yyyy"
#: Other usual forms, each with the pattern that a value of that form has.
TIME_FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}/\d{2}/\d{2}( \d{2}:\d{2}:\d{2})?$", "yyyy/MM/dd[ HH:mm:ss]"),
    (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?$", "yyyy-MM-dd['T'][ ]HH:mm[:ss]"),
    (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\.\d{1,6}$", "yyyy-MM-dd['T'][ ]HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"),
    (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:?\d{2})$", "yyyy-MM-dd['T'][ ]HH:mm:ss[XXX][XX]"),
    (r"^\d{2}/\d{2}/\d{4}( \d{2}:\d{2}(:\d{2})?)?$", "MM/dd/yyyy[ HH:mm[:ss]]"),
)


def parse_post_time(c: Column | str) -> Column:
    """Twitter-style timestamps, ISO dates and times and month-first dates; rows that do not
    parse become NULL (not the whole column).

    The value's own form picks the format, so no value can match two.
    """
    x = F.trim(_col(c))
    rest = F.substring(x, 5, 1 << 20)
    numeric_zone = rest.rlike(r"^\w{3} \d{2} \d{2}:\d{2}:\d{2} [+-]\d{4} \d{4}$")
    out = F.when(numeric_zone, F.try_to_timestamp(rest, F.lit(POST_TIME_OFFSET_FORMAT)))
    for pattern, form in TIME_FORMATS:
        out = out.when(x.rlike(pattern), F.try_to_timestamp(x, F.lit(form)))
    return out.otherwise(F.try_to_timestamp(rest, F.lit(POST_TIME_FORMAT)))


def percent_label(label: Column, pct: Column) -> Column:
    """``'<label>\\n(<pct with one decimal>%)'``; rounding is half-even on the exact double."""
    return F.concat(label, F.lit("\n("), F.format_number(pct.cast("double"), 1), F.lit("%)"))
