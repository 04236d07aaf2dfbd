"""Text expressions: Column in, Column out, all within whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number, a date, a quantity with unit, and an identifier.
NUMBER = r"\b\d+[\d.,/-]*\b"
DATE = r"\b(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2})\b"
UNIT_TOKEN = r"(?i)\b(\d+\s?)(mm|cm|m|km|mg|g|kg|ml|l|lb|oz|ft|in|psi|kpa|bar|deg|pc|%)\b"
UNIT = r"(?i)\b\d+\s?(mm|cm|m|km|mg|g|kg|ml|l|lb|oz|ft|in|psi|kpa|bar|deg|%)\b"
IDENTIFIER = r"\b([A-Z]{2,}\d+|\d+[A-Z]{2,})\b"
#: Blanks of any script, as the reference has them; the controls at the end count as blanks there too.
BLANK = r"[\s\x1c-\x1f]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; bodies of lambdas have no common subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize(text: Column) -> Column:
    """Small letters, no outer blanks, single blanks."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), rf"(?U)^{BLANK}+|{BLANK}+$", ""), rf"(?U){BLANK}+", " ")


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda t: t != "")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"\s+", "") == "", F.lit(True))


#: One pattern for all four kinds of critical words; each of them holds a digit.
CRITICAL = f"(?U){NUMBER}|{DATE}|(?i:{UNIT_TOKEN.removeprefix('(?i)')})|{IDENTIFIER}"


def is_critical(word: Column) -> Column:
    """A number, date, quantity or identifier (the latter in capitals, so never in normalized text)."""
    return F.coalesce(word.rlike(r"\p{Nd}") & word.rlike(CRITICAL), F.lit(False))  # letters and digits of any script


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def dates(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(DATE), 1), " ")


def units(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(UNIT), 0), " ")


def edit_ratio(a: Column, b: Column) -> Column:
    return F.when(a == b, 0.0).otherwise(F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def style_category(text: Column, ordinal: Column) -> Column:
    """Lines with digits, long lines with punctuation, and the rest in turn."""
    turn = F.element_at(F.array(*[F.lit(s) for s in ("neat", "cursive", "messy", "difficult_faint")]), (ordinal % 4 + 1).cast("int"))
    return F.when(text.rlike("[0-9]"), "numbers_and_punctuation").when(text.rlike("[,;:\"'!?()-]") & (F.length(text) > 60), "punctuation_and_complex").otherwise(turn)


def sanitize_filename(name: Column, default: str = "document", most: int = 150) -> Column:
    base = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"\.\.+", "")
    clean = F.substring(F.regexp_replace(base, r"[^a-zA-Z0-9_\-. ]", "_"), 1, most)
    clean = F.regexp_replace(clean, r"^ +| +$", "")
    return F.when(F.coalesce(clean, F.lit("")).isin("", ".", ".."), default).otherwise(clean)


def iso_date(text: Column) -> Column:
    """dd-mm-yyyy as yyyy-mm-dd, by its shape alone; anything else is null."""
    shape = r"^(\d{2})[-/](\d{2})[-/](\d{4})$"
    return F.when(text.rlike(shape), F.regexp_replace(text, shape, "$3-$2-$1"))


def human_size(size: Column) -> Column:
    kb = size / 1024.0
    return F.when(kb < 1024, F.format_string("%.1f KB", kb)).otherwise(F.format_string("%.1f MB", kb / 1024.0))


def percent(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "Not provided").otherwise(F.format_string("%.1f%%", confidence * 100))


def replace_line(text: Column, expected: Column, by: Column) -> Column:
    """The text with its one full line ``expected`` replaced; null if that line is not there exactly once."""
    lines = F.split(text, "\n")
    once = F.size(F.filter(lines, lambda x: x == expected)) == 1
    return F.when(once, F.array_join(F.transform(lines, lambda x: F.when(x == expected, by).otherwise(x)), "\n"))


def mime_of(content: Column) -> Column:
    """The type that the first bytes show."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("25504446"), "application/pdf").when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    )


def upload_error(content: Column, declared: Column, filename: Column, most: int = 20 * 1024 * 1024) -> Column:
    """Why an upload is refused, null if it is not; the first reason counts."""
    told = F.when(F.lower(declared) == "image/jpg", "image/jpeg").otherwise(F.lower(declared))
    suffix = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    allowed = F.create_map(*[F.lit(x) for kv in (("pdf", "application/pdf"), ("png", "image/png"), ("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("webp", "image/webp")) for x in kv])
    found = mime_of(content)
    return (
        F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "EMPTY_FILE").when(F.length(content) > most, "FILE_TOO_LARGE")
        .when(~F.coalesce(told.isin("application/pdf", "image/png", "image/jpeg", "image/webp"), F.lit(False)), "UNSUPPORTED_TYPE")
        .when(found.isNull(), "UNKNOWN_SIGNATURE").when(found != told, "SIGNATURE_MISMATCH").when((suffix != "") & ~allowed[suffix].eqNullSafe(found), "EXTENSION_MISMATCH")
    )


def to_utc(text: Column) -> Column:
    """An ISO time as UTC: with ``Z`` or an offset as told, without one taken for UTC; null if it is none. Needs the session's time zone UTC."""
    return F.regexp_replace(text, "Z$", "+00:00").try_cast("timestamp")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def client_status(status: Column, known: tuple[str, ...], default: str) -> Column:
    """A status that a client knows, else the default."""
    return F.when(status.isin(*known), status).otherwise(default)


def envelope_error(code: Column, job: Column, message: Column, full: int = 10010) -> Column:
    """Why a provider's answer is no accepted job, null if it is one."""
    refused = F.coalesce(code != 0, F.lit(True)) | (F.coalesce(job, F.lit("")) == "")
    return F.when(refused, F.when(code == full, "QUEUE_FULL").otherwise(F.coalesce(F.nullif(message, F.lit("")), F.lit("UNKNOWN"))))
