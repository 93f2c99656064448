"""Text normalisation and small scalar functions, as columns. Null in, null out, unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# ---- fixed values ----

#: Question and function words that carry no weight in ranking.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "does", "do", "for", "from", "has", "have", "how", "in", "is", "it", "its", "of", "on", "or",
    "that", "the", "this", "to", "was", "what", "when", "where", "which", "who", "why", "with",
]
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff"}
QUOTES_FROM, QUOTES_TO = "’‘“”–—", "''\"\"--"
BLANK = r"[\s\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"  # white space, and the control characters that become spaces
MATH_SYMBOLS = {"√": "sqrt", "∞": "infty", "×": "times", "≤": "leq", "≥": "geq", "≈": "approx", "∑": "sum", "∏": "prod", "·": "cdot", "⋅": "cdot"}
LATEX_STYLE = r"\\(?:text|mathrm|mathbf|mathit|mathcal|operatorname|left|right|big|Big)(?![a-zA-Z])"
MIN_QUOTE_CHARS = 12
MIN_PIECE = 40
SECTION_NUMBER = r"(?:(?:[1-9]|1\d)(?:\.\d+){0,2}\.?|[A-H](?:\.\d+){0,2}\.?)"
#: The same with numbers of any length: for documents known to have more than 19 sections, where a number before a title isn't a year or a count.
LONG_SECTION_NUMBER = SECTION_NUMBER.replace(r"(?:[1-9]|1\d)", r"[1-9]\d{0,8}")
NUMBERED_TITLE = r"\s+([A-Z0-9√(].{1,90})$"
HEADING_NUMBERED = rf"^({SECTION_NUMBER}){NUMBERED_TITLE}"
LONG_HEADING_NUMBERED = rf"^({LONG_SECTION_NUMBER}){NUMBERED_TITLE}"
HEADING_NAMED = r"(?i)^(abstract|introduction|related work|background|conclusions?|discussion|acknowledge?ments?|references|bibliography|appendix(?:\s+[a-z])?)$"
HEADING_ROMAN = r"^(?:[IVX]{1,5})\.\s+[A-Z][A-Z0-9 ,:&/\-]{2,80}$"
NUMBER_ONLY = rf"^{SECTION_NUMBER}$"
LONG_NUMBER_ONLY = rf"^{LONG_SECTION_NUMBER}$"
STOP_SECTIONS = r"(?i)^(references|bibliography)$"
APPENDIX_START = r"(?i)^(appendix\b|[A-H](?:\.\d+)*\.?\s+[A-Z])"
AFFILIATION = r"(?i)univ|institut|\binc\b|\blabs?\b|technolog|research|corporation|college|google|microsoft|nvidia|facebook|meta ai|deepmind|@"
INTRO_LIKE = r"(?i)introduction|background|overview|motivation"

# ---- columns ----


def normalize(text: Column) -> Column:
    """Ligatures and quotes unified, control characters to spaces, words joined over a hyphen at a line end, white space collapsed."""
    unified = text
    for old, new in LIGATURES.items():
        unified = F.replace(unified, F.lit(old), F.lit(new))
    text = F.when(F.octet_length(text) > F.length(text), F.translate(unified, QUOTES_FROM, QUOTES_TO)).otherwise(text)  # ASCII has none of them
    text = F.when(F.contains(text, F.lit("-")) & F.contains(text, F.lit("\n")), F.regexp_replace(text, rf"(?U)(\w)-{BLANK}*\n{BLANK}*(\w)", "$1$2")).otherwise(text)
    return F.trim(F.regexp_replace(text, rf"(?U) {BLANK}+|[{BLANK}&&[^ ]]{BLANK}*", " "))  # a single space is left alone


def slug(title: Column) -> Column:
    """Lower-case letters and digits joined by hyphens, at most 40 characters; 'body' if nothing is left."""
    bare = F.btrim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.left(bare, F.lit(40)), F.lit("")), F.lit("body"))


def all_caps(text: Column) -> Column:
    """More than three letters, and all of them upper case."""
    return (F.regexp_count(text, F.lit(r"\p{L}")) > 3) & ~text.rlike(r"[\p{L}&&[^\p{Lu}]]")


def _capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def clean_title(title: Column) -> Column:
    """Trailing dots dropped; capitals become sentence case after the number."""
    bare = F.regexp_replace(title, r"\.+$", "")
    head = F.substring_index(bare, " ", 1)
    rest = F.when(F.contains(bare, F.lit(" ")), F.substr(bare, F.length(head) + 2)).otherwise(F.lit(""))
    numbered = head.rlike(r"^[\dIVX.A-H]+$")
    return F.when(~all_caps(bare), bare).when(numbered, F.concat(head, F.lit(" "), _capitalized(rest))).otherwise(_capitalized(bare))


#: Texts that are held as Python strings at a time, whatever the size of a batch.
ROWS = 128


def _mapped(text: pa.Array, change: Callable[[str], str]) -> pa.Array:
    parts = [pa.array([None if t is None else change(t) for t in text.slice(lo, ROWS).to_pylist()], pa.string()) for lo in range(0, len(text), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return _mapped(text, lambda t: unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility composition. ASCII texts, which it can't change, don't leave the JVM."""
    other = text.rlike(r"[^\x00-\x7F]")
    return F.when(other, _nfkc(F.when(other, text))).otherwise(text)


def strip_to_alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def squash(text: Column, compatibility: bool = True) -> Column:
    """Lower-case ASCII letters and digits only, after NFKC."""
    return strip_to_alnum(nfkc(text) if compatibility else text)


def _math_names() -> dict[str, str]:
    """Symbols by name; Greek letters by the last word of their Unicode name."""
    greek = {chr(c): unicodedata.name(chr(c), "") for block in (range(0x370, 0x400), range(0x1F00, 0x2000)) for c in block}
    return MATH_SYMBOLS | {c: name.split()[-1].lower() for c, name in greek.items() if name.startswith("GREEK ")}


@F.arrow_udf(StringType())
def _spell_math(text: pa.Array) -> pa.Array:
    table = str.maketrans(_math_names())
    return _mapped(text, lambda t: t.translate(table))


def squash_math(text: Column) -> Column:
    """`squash` that also equates LaTeX commands with the symbols they stand for."""
    text = F.regexp_replace(nfkc(text), LATEX_STYLE, "")
    text = F.regexp_replace(F.regexp_replace(text, r"\\le(?![a-zA-Z])", r"\\\\leq"), r"\\ge(?![a-zA-Z])", r"\\\\geq")
    other = text.rlike(r"[^\x00-\x7F]")
    return squash(F.when(other, _spell_math(F.when(other, text))).otherwise(text))


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some texts one after the other (null: none), and where each of them begins and the last ends."""
    held = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(held):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    data = held.buffers()[2]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]), at - at[0]


_WORD = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def token_lists(lowered: pa.Array) -> pa.ListArray:
    """`words` without stop words of texts in lower case, from their bytes; a null text has an empty list."""
    data, at = utf8(lowered)
    inside = _WORD[data]
    ends, held = at[1:], at[1:] > at[:-1]
    first, last = inside.copy(), inside.copy()  # a word's first and last bytes; no word runs on into the next text
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[at[:-1][held]] = inside[at[:-1][held]]
    last[ends[held] - 1] = inside[ends[held] - 1]
    start = np.flatnonzero(first)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - start)]).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    kept = pc.invert(pc.is_in(flat, value_set=pa.array(STOPWORDS, pa.string())))
    before = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(before[np.searchsorted(start, at)], pa.int32()), flat.filter(kept))


#: Texts that are cut into words at a time, whatever the size of a batch.
CUT_ROWS = 256


def give_back() -> None:
    """Arrow keeps the memory that it has freed; workers that wait for their next task would hold it beside those that work."""
    pa.default_memory_pool().release_unused()


@F.arrow_udf(ArrayType(StringType()))
def _tokens(lowered: pa.Array) -> pa.Array:
    give_back()  # what the batch before took
    parts = [token_lists(lowered.slice(lo, CUT_ROWS)) for lo in range(0, len(lowered), CUT_ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


def tokenize(text: Column) -> Column:
    """`words` without stop words. Bytes are cut by numpy: a regular expression costs more for each word than all the rest."""
    return F.when(text.isNotNull(), _tokens(F.lower(text)))


def with_header(title: Column, paper_id: Column, section: Column, text: Column) -> Column:
    return F.concat(F.coalesce(title, paper_id), F.lit(". "), section, F.lit(". "), text)


def line_key(text: Column) -> Column:
    """A running line's text with its numbers masked."""
    return F.regexp_replace(F.lower(text), r"\d+", "#")


def fragments(quote: Column) -> Column:
    """Parts of a quote between ellipses."""
    return F.split(quote, r"\.{3,}|…")


def ordered_containment(parts: Column, haystack: Column, least: int = MIN_QUOTE_CHARS) -> Column:
    """Whether all parts of `least` characters or more (and one at least) stand in the haystack, in order and apart."""
    long_ = F.filter(parts, lambda p: F.length(p) >= least)
    place = F.aggregate(long_, F.lit(1), lambda at, p: _after(p, haystack, at))
    return (F.size(long_) > 0) & (place > 0)


def _after(part: Column, haystack: Column, at: Column) -> Column:
    found = F.position(part, haystack, F.greatest(at, F.lit(1)))
    return F.when((at == 0) | (found == 0), F.lit(0)).otherwise(found + F.length(part))


def cost_usd(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def fmt(value: Column, percent: bool = False) -> Column:
    shown = F.format_string("%.1f%%", value * 100) if percent else F.format_string("%.3f", value)
    return F.when(value.isNull(), F.lit("–")).otherwise(shown)


def overlap_score(a: Column, b: Column) -> Column:
    """Distinct words that two texts share."""
    return F.size(F.array_intersect(words(a), words(b))).cast("double")


def query_text(question: Column, model: str = "") -> Column:
    """BGE models take an instruction before a query, and none before a passage."""
    return F.concat(F.lit("Represent this sentence for searching relevant passages: "), question) if "bge" in model.lower() else question
