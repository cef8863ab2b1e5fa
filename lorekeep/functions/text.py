"""Column functions over text: tokens, keys, hashes, estimates, windows.

All are built from native functions, take and return columns, and treat null
text as empty unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no weight in retrieval (English, then Russian).
STOP_WORDS = [
    "the", "and", "for", "are", "was", "were", "with", "that", "this", "from",
    "have", "has", "had", "but", "not", "you", "your", "our", "their", "his",
    "her", "its", "into", "about", "what", "which", "when", "where", "how", "here",
    "что", "как", "для", "или", "это", "при", "без", "тот", "его", "она",
    "они", "был", "была", "быть", "тоже", "также", "если", "тогда", "потом",
    "когда", "очень", "более", "менее", "нет", "уже", "ещё", "еще", "какие",
    "какой", "какая", "какое", "где", "через",
]

# Characters a token, by class, of the token estimate.
CYRILLIC_CHARS, WORD_CHARS, SYMBOL_CHARS, RUN_TOKENS = 3.5, 8.1, 2.1, 1.1
MESSAGE_TOKENS, MEDIA_TOKENS = 4, 4096

WORD_BREAK = r"[^\p{L}\p{N}]+"
FRONTMATTER = r"\A---\n(?s:.*?)\n---\n?"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def is_token(word: Column) -> Column:
    """Three characters or more, or a letter beside a digit, and no stop word."""
    return ((F.length(word) > 2) | word.rlike("[a-zа-я][0-9]|[0-9][a-zа-я]")) & ~word.isin(STOP_WORDS)


def tokens(text: Column) -> Column:
    """Lower-case words that are tokens; duplicates stay."""
    return F.filter(F.split(F.lower(text_or_empty(text)), WORD_BREAK), is_token)


def token_set(text: Column) -> Column:
    """Distinct tokens in order of first appearance."""
    return F.array_distinct(tokens(text))


def query_tokens(text: Column) -> Column:
    """Distinct runs of three or more letters and digits, lower-case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(r"[\p{L}\p{N}]{3,}"), 0))


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits with one blank between them; null without any."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(text), WORD_BREAK, " ")), F.lit(""))


def coverage(query: Column, other: Column) -> Column:
    """Share of the query's tokens among the other tokens (0 without any)."""
    return F.when((F.size(query) == 0) | (F.size(other) == 0), 0.0).otherwise(F.size(F.array_intersect(query, other)) / F.size(query))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two token sets, 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def lexical_overlap(left: Column, right: Column) -> Column:
    """How many words of ``left``, repeats included, are among ``right``."""
    return F.size(F.filter(left, lambda w: F.array_contains(right, w)))


def phrase_bonus(matched: Column, n_query: Column, text: Column) -> Column:
    """1 if two matched tokens that follow each other in the query are adjacent
    in the text (lower-case), else their share up to 0.75; 0 with fewer than two."""
    adjacent = F.exists(
        F.arrays_zip(F.slice(matched, 1, F.size(matched) - 1).alias("a"), F.slice(matched, 2, F.size(matched) - 1).alias("b")),
        lambda p: F.regexp_like(text, F.concat(p["a"], F.lit(WORD_BREAK), p["b"])),
    )
    return F.when(F.size(matched) < 2, 0.0).when(adjacent, 1.0).otherwise(F.least(F.lit(0.75), F.size(matched) / n_query))


def length_penalty(length: Column, threshold: int, floor: float) -> Column:
    return F.when(length <= threshold, 1.0).otherwise(F.greatest(F.lit(floor), F.lit(float(threshold)) / length))


def chunk_key(heading: Column, body: Column) -> Column:
    """Lower-case heading and body with white space collapsed and trimmed."""
    joined = F.lower(F.concat(text_or_empty(heading), F.lit("\n"), text_or_empty(body)))
    return F.trim(F.regexp_replace(joined, r"[\s\p{Z}]+", " "))


def section_key(heading: Column) -> Column:
    """Comparable form of a section heading."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text_or_empty(heading), r"\A#+\s*", "")), r"\s+", " "))


def without_frontmatter(content: Column) -> Column:
    return F.regexp_replace(text_or_empty(content), FRONTMATTER, "")


def without_frontmatter_and_title(content: Column) -> Column:
    body = F.regexp_replace(without_frontmatter(content), r"\A\s+", "")
    return F.regexp_replace(body, r"\A#\s+[^\n]*\n?", "")


def source_body(content: Column) -> Column:
    """Content without frontmatter, right-trimmed: what change detection hashes."""
    return F.regexp_replace(without_frontmatter(content), r"\s+\z", "")


def _utf16_fold(text: Column, start: int, step) -> Column:
    """Folds ``step(state, unit)`` over the UTF-16 units of a text."""

    def units(state: Column, char: Column) -> Column:
        point = F.ascii(char).cast("long")
        high, low = F.shiftright(point - 0x10000, 10) + 0xD800, (point - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00
        return F.when(point < 0x10000, step(state, point)).otherwise(step(step(state, high), low))

    chars = F.filter(F.split(text_or_empty(text), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(start).cast("long"), units)


def fnv1a(text: Column) -> Column:
    """FNV-1a of 32 bits over UTF-16 units, as eight hexadecimal digits."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    value = _utf16_fold(text, 0x811C9DC5, lambda h, u: (h.bitwiseXOR(u) * F.lit(0x01000193).cast("long")).bitwiseAND(mask))
    return F.lpad(F.lower(F.hex(value)), 8, "0")


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("fnv1a:"), fnv1a(text))


def source_hash(content: Column) -> Column:
    return content_hash(source_body(content))


def annotation_hash(text: Column) -> Column:
    """Signed 32-bit hash with multiplier 31, unsigned, in base 36."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    value = _utf16_fold(text, 0, lambda h, u: (h * 31 + u).bitwiseAND(mask))
    return F.lower(F.conv(value.cast("string"), 10, 36))


def measure_text(text: Column) -> Column:
    """struct<raw double, bytes long>: estimated tokens by character class, UTF-8 length."""
    t = text_or_empty(text)
    # Runs are taken out whole: a match a character takes many times as long, and a group a character overflows the stack.
    length = lambda pattern, of=t: F.length(F.regexp_replace(of, pattern + "+", ""))
    cyrillic = length(r"[^\x{0400}-\x{052F}]")
    cjk = length(r"[^\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]")
    newline = length(r"[^\n]")
    digit = r"0-9"
    other = r"[[^\n0-9A-Za-z \t\r\p{L}\p{M}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x{0400}-\x{052F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}][\x0B\x0C]]"
    # Plain letters and blanks only part signs; the class of signs, which is slow, sees one for a run of them.
    parted = F.regexp_replace(t, r"[A-Za-z \t\r]+", "a")
    symbols = F.length(parted) - length(f"[{other}{digit}]", parted)
    # A run is unbroken digits or unbroken other signs; each line feed is one too.
    runs = F.regexp_count(parted, F.lit(f"{other}+|[{digit}]+")) + newline
    word = F.length(t) - cyrillic - cjk - newline - symbols
    raw = cyrillic / F.lit(CYRILLIC_CHARS) + cjk + word / F.lit(WORD_CHARS) + symbols / F.lit(SYMBOL_CHARS) + runs * F.lit(RUN_TOKENS)
    return F.struct(raw.alias("raw"), F.octet_length(t).cast("long").alias("bytes"))


def capped_tokens(measure: Column) -> Column:
    """A byte-level tokenizer has no more tokens than bytes."""
    return F.least(measure["raw"], measure["bytes"].cast("double"))


def estimate_tokens(text: Column, calibration: float = 1.0) -> Column:
    return F.ceil(F.round(capped_tokens(measure_text(text)) * calibration, 9)).cast("long")


def estimate_messages(texts: Column, images: Column | None = None, calibration: float = 1.0) -> Column:
    """Estimate of an array of message texts, with an allowance a message and an image."""
    total = F.aggregate(F.transform(texts, lambda t: estimate_tokens(t)), F.lit(0).cast("long"), lambda n, x: n + MESSAGE_TOKENS + x)
    if images is not None:
        total = total + images * MEDIA_TOKENS
    return F.ceil(total * calibration).cast("long")


def window_starts(length: Column, size: int, overlap: int) -> Column:
    """Zero-based starts of windows of ``size`` that overlap; the last one reaches the end."""
    step = max(1, size - overlap)
    last = F.when(length <= size, F.lit(0)).otherwise(F.ceil((length - size) / step) * step)
    return F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))


def sliding_windows(text: Column, size: int, overlap: int) -> Column:
    """array<struct<start, text>> of character windows; none for empty text."""
    t = text_or_empty(text)
    made = F.transform(window_starts(F.length(t), size, overlap), lambda s: F.struct(s.alias("start"), F.substring(t, s + 1, F.lit(size)).alias("text")))
    return F.when(F.length(t) == 0, F.array().cast("array<struct<start:bigint,text:string>>")).otherwise(made)


def excerpt(query: Column, body: Column, size: int) -> Column:
    """``size`` characters of the body, a third of them before the earliest query token."""
    flat = F.trim(F.regexp_replace(text_or_empty(body), r"\s+", " "))
    low = F.lower(flat)
    hit = F.array_min(F.filter(F.transform(query, lambda w: F.instr(low, w)), lambda p: p > 0))
    start = F.greatest(F.lit(0), F.coalesce(hit, F.lit(1)) - 1 - size // 3)
    return F.when(F.length(flat) <= size, flat).otherwise(F.trim(F.substring(flat, start + 1, F.lit(size))))


def technical_values(text: Column) -> Column:
    """Distinct IPv4 addresses, UUIDs, versions and quantities with units."""
    pattern = (
        r"\b(?:\d{1,3}\.){3}\d{1,3}\b|\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b"
        r"|\bv?\d+\.\d+(?:\.\d+)*\b|\b\d+(?:\.\d+)?\s?(?:KB|MB|GB|TB|ms|s|min|%)(?!\w)"
    )
    return F.array_distinct(F.regexp_extract_all(text_or_empty(text), F.lit(pattern), 0))


def urls(text: Column) -> Column:
    """Distinct URLs without trailing punctuation."""
    found = F.regexp_extract_all(text_or_empty(text), F.lit(r"https?://[^\s<>\"'`\])}]+"), 0)
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+\z", "")))


def tag(raw: Column) -> Column:
    """Normalised tag: no leading #, trimmed slashes, lower case, dashes for spaces."""
    t = F.regexp_replace(F.trim(text_or_empty(raw)), r"\A#+", "")
    t = F.lower(F.regexp_replace(t, r"\A/+|/+\z", ""))
    return F.regexp_replace(t, r"[\s_]+", "-")


def clamp_int(value: Column, fallback: int, low: int, high: int) -> Column:
    return F.least(F.greatest(F.floor(F.coalesce(value.try_cast("double"), F.lit(float(fallback)))), F.lit(low)), F.lit(high)).cast("int")
