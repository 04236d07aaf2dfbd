"""Personal information in free text, replaced by typed placeholders (problem 5).

Regular expressions propose spans with a first score. Validators decide where a format has a check digit or ranges
that are never issued (Luhn, mod-97, Verhoeff): a confirmed number stands without any label, a refused one
not even with one; numbers of formats without a check are left to the context. Words near a span raise or lower its score, for names
too: any given name or initial with a surname is proposed by its shape, and a title, a role, a verb or another mention decides.
Spans from ``THRESHOLD`` on are kept; where spans overlap, the higher score, then the longer span wins.

Texts are searched whole, one Arrow batch at a time, without a shuffle but for the final ``distinct``.
Defined results: null and empty texts have no mention; offsets count the characters of the stored text;
a mention may run over line ends; a null block is skipped; a block given twice gives its rows once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.6


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    score: float


# --- validators ----------------------------------------------------------------------------------


def digits_of(text: str) -> str:
    return re.sub(r"\D", "", text)


def luhn(text: str) -> bool:
    d = digits_of(text)
    return len(d) > 1 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def mod97(text: str) -> bool:
    """The account number rule: the first four characters go to the end, letters count from 10, the rest is 1."""
    t = re.sub(r"\s", "", text).upper()
    if not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", t):
        return False
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _dihedral(a: int, b: int) -> int:
    """Product in the symmetry group of the pentagon."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


def verhoeff(text: str) -> bool:
    shift = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    check = 0
    for i, x in enumerate(map(int, reversed(digits_of(text)))):
        for _ in range(i % 8):
            x = shift[x]
        check = _dihedral(check, x)
    return bool(digits_of(text)) and check == 0


# --- proposals -----------------------------------------------------------------------------------

GAP = r"[^\S\n]*\n?[^\S\n]*"  # blanks, or one line end
HY = r"[-‐‑]"  # a hyphen, at a line end perhaps
_LOCAL = rf"[A-Za-z0-9](?:[A-Za-z0-9._%+]|{HY}\n?)*"
_AT = r"(?:\s?[@＠]\s?|\s?\[at\]\s?|\s?\(at\)\s?|\s?\{at\}\s?)"
_DOT = r"(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?|\s?\{dot\}\s?)"
_LABELPART = rf"[A-Za-z0-9](?:[A-Za-z0-9]|{HY}\n?)*"
EMAIL = re.compile(rf"(?<![\w.@-]){_LOCAL}(?:{_AT}{_LABELPART}(?:{_DOT}{_LABELPART})*{_DOT}[A-Za-z]{{2,}}|\s+at\s+{_LABELPART}(?:\s+dot\s+{_LABELPART})*\s+dot\s+[A-Za-z]{{2,}})(?![\w@])", re.IGNORECASE)

_D = r"[\dOo]"
PHONE = re.compile(
    rf"(?<![\w.+/-])(?:\+{GAP}\d{{1,3}}[\s.-]{{0,2}}|1(?:\s|{HY}\n?))?(?:\(\d{{2,5}}\)[\s.-]{{0,2}})?{_D}{{2,8}}(?:(?:\s|\.|{HY}\n?){_D}{{2,8}}){{0,5}}(?:\s*,?\s*(?:ext|extension|x)\.?\s*\d{{1,5}})?(?![\w/])(?!{HY}\d)", re.IGNORECASE
)
PHONE_LABEL = re.compile(r"(?:\b(?:te[l1i]|te[l1i]ephone|phone|fax|ca[l1i]{2}|mobi[l1i]e|ce[l1i]{2}|whatsapp|ring|dia[l1i])\b\W*(?:n[o0]\b\W*)?|\b(?:reach|contact)\b[^.]{0,25}\s[o0]n\s+)$", re.IGNORECASE)
#: The digit groups of number plans that need no label.
PHONE_STRONG = re.compile(r"^(?:\+|00\d|\(\d|0\d{2,4}[\s-]\d{3,4}[\s-]?\d{3,4}$|1-8\d\d-|\d{3}-555-|07\d{3}\s)")

#: What a validator's answer adds to a score; None: the format has no check, or not for this number.
CHECKED = {True: 0.5, False: -0.5, None: 0.0}


def ssn_range(text: str) -> bool | None:
    """Areas 000 and 666 are never issued."""
    return False if digits_of(text)[:3] in ("000", "666") else None


def twelve(text: str) -> bool | None:
    """Issued numbers of this form begin with 2 to 9 and end in a check digit; others are some other register's."""
    return verhoeff(text) if digits_of(text)[0] in "23456789" else None


def unchecked(text: str) -> None:
    return None


ID_FORMATS: list[tuple[re.Pattern, float, Callable[[str], bool | None]]] = [
    (re.compile(r"(?<![\w-])[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D](?![\w-])"), 0.6, unchecked),
    (re.compile(rf"(?<![\w-])\d{{3}}{HY}\n?\d{{2}}{HY}\n?\d{{4}}(?![\w-])"), 0.6, ssn_range),
    (re.compile(r"(?<![\w-])\d{4}\s\d{4}\s\d{4}(?![\w-]|\s\d{4})"), 0.45, twelve),
    (re.compile(r"(?<![\w-])\d{12}(?![\w-])"), 0.45, twelve),
    (re.compile(rf"(?<![\w-])\d{{5}}{HY}\n?\d{{4}}{HY}\n?\d{{2}}[A-Z](?![\w-])"), 0.6, unchecked),
    (re.compile(r"(?<![\w-])[A-Z]{2}\d{2}\s\d{7,11}(?![\w-])"), 0.6, unchecked),
    (re.compile(r"(?<![\w-])[A-Z]\d{7,8}(?![\w-])"), 0.6, unchecked),
    (re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?(?![\w-])"), 0.3, lambda t: mod97(t) if len(re.sub(r"\s", "", t)) > 14 else None),
    (re.compile(r"(?<![\w-])\d{4}(?:[\s-]?\d{4}){3}(?![\w-])"), 0.3, luhn),
    (re.compile(rf"(?<![\w-])(?=(?:[A-Z\s-]*\d){{6}})[A-Z0-9]{{2,}}(?:(?:\s|{HY}\n?)[A-Z0-9]{{2,}}){{0,4}}(?![\w-])"), 0.2, unchecked),
]
SIX_DIGITS = re.compile(r"(?:\d\D*){6}")  # every format and every phone number holds six
ID_LABEL = re.compile(
    r"(?:passport|citizen(?:ship)?|nationa[l1i]|personal|soc[i1l]a[l1i]\s+\S{6,9}|insurance|identity|\bID\s+card|\b[i1l]d\b|driv[i1l]n[gq9]|driver'?s|licen[cs]e|lieence|tax(?:payer)?|\bNIN\b|\bSSN\b)\W*(?:(?:[i1l]d|card|number|nurnber|numbcr|no|n0|licen[cs]e|[l1i]ieence|licencc|security|identification)\W*){0,3}$",
    re.IGNORECASE,
)
ID_OTHER = re.compile(r"(?:batch|order|sample|lab(?:oratory)?|invoice|inv|reference|ref|scale|page|room|register|bed|lot|serial|article)\W*(?:(?:id|no|n0|number|lab)\W*)*$", re.IGNORECASE)

_CAP = r"(?:[A-Z][^\W\d_]*(?:['’][^\W\d_]+)?)"
_ORD = r"\d{1,3}(?:st|nd|rd|th|ST|ND|RD|TH)"
#: What a street's name ends with.
STREET_WORDS = "Street|St|Road|Rd|Lane|Ln|Close|Row|Avenue|Ave|Way|Hill|Drive|Place|Court|Square|Terrace|Crescent|Gardens|Mews|Walk|Nagar|Salai|Gate|Green|Boulevard|Alley|Quay|Bridge|Park"
_STREET = rf"(?:(?:{_ORD}|{_CAP})\s+(?:{_CAP}\s+){{0,3}}?(?:{STREET_WORDS}|{STREET_WORDS.upper()}))\b"
_NEAR = r"(?:\s\([^()]{3,40}\))?"
_TOWN = rf"{_CAP}(?:\s{_CAP}){{0,1}}"
_CODE = r"(?:[A-Z]{1,2}\d{1,2}[A-Z]?\s\d[A-Z]{2}|[-–]\s\d{3}\s\d{3}|\d{5,6}|\d{3}\s\d{3})"
_HOUSE = r"(?:(?:Flat|Apartment|Apt\.?|Unit|Door|No\.|House|FLAT|DOOR|NO\.)\s(?:No\.\s)?\d{1,4}[A-Za-z]?(?:/\d{1,4})?,\s(?:\d{1,4}[A-Za-z]?(?:/\d{1,3})?,?\s)?|\d{1,4}[A-Za-z]?(?:/\d{1,4})?,?\s)"
ADDRESS = re.compile(
    (rf"(?<![\w/-])(?:{_HOUSE}{_STREET}{_NEAR},\s(?P<town>{_TOWN})(?:\s(?P<code>{_CODE}))?|(?P<weg>{_CAP}(?:weg|straße|strasse|gasse|platz|allee|WEG|STRASSE|GASSE|PLATZ))\s\d{{1,4}}[a-z]?,\s\d{{5}}\s(?P<ort>{_TOWN}))(?![\w])").replace(r"\s", r"\s")
)
_SENTENCE = re.compile(r"\s[A-Z][a-z]*$")

_L = r"[^\W\d_]{2,}(?:['’][^\W\d_]{2,})?(?:(?:-\n?|[‐‑¬­] ?\n|- \n)[^\W\d_]{2,})*"
_O = r"[^\W\d_]['’][^\W\d_]{2,}(?:-\n?[^\W\d_]{2,})?"
_W = rf"(?:{_O}|{_L})"
_I = r"(?<![^\W_])[^\W\d_]\."
NAME = rf"(?:{_W}{GAP}\s{_I}{GAP}\s{_W}|{_I}{GAP}(?:\s{_I}{GAP})?\s?{_W}|{_W},{GAP}\s(?:{_W}|{_I})|{_W}{GAP}\s{_W})".replace(rf"{GAP}\s", r"(?:[^\S\n]*\n[^\S\n]*|[^\S\n]+)")
_TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Pt|Sr|Herr|Frau|Dra|Don|Doña)\b\.?\s+)"
NAME_BEFORE = re.compile(
    rf"(?:\b(?:Pt|Mrs|Mr|Ms|Dr|Prof|PT|MRS|MR|DR)\.\s+|\b(?:Pat[i1l]en[tf]\s+nam[ec]|N[ao]m[ec]|Narn[ec])\b:?\s+{_TITLE}?|\bS[i1l][gq9]n[ec](?:d|cl)\b:?\s+(?:by\s+)?{_TITLE}?|\bAcc[o0]r(?:d|cl)[i1l]n[gq9]\s+t[o0]\s+{_TITLE}?|\b[hb]a[nu](?:d|cl)[ec](?:d|cl)\s+t[o0]\s+{_TITLE}?|\b[kKl][i1l][nu]:\s+{_TITLE}?|\bA[tf]{{2}}[ec]n(?:d|cl)[ec](?:d|cl)\s+[b6hB]y\s+{_TITLE}?|\b(?:Dear|Contact|Mother|Father|Wife|Husband|Daughter|Son):?\s+{_TITLE})(?P<name>{NAME})"
)
AFTER = re.compile(r"\s+[ao][s5]k[ec](?:d|cl)\s+[ft][o0]r\s+t[hb][ec]\b")
NAME_AT_END = re.compile(rf"(?<![^\W_]['’])(?<![\w@.-])(?P<name>{NAME})$")
LONGEST_NAME = 120
NAME_IN_HEAD = re.compile(rf"(?:\s/\s|:\s|\s-\s(?:P[tf]\.|PT\.)\s)(?P<name>{NAME})(?=[^\S\n]*(?:[^\S\n]{{2,}}\S{{1,4}}[^\S\n]*)?(?:\n|$))")
#: Words that name an institution, a book or a form and not a person.
NO_NAME = re.compile(
    r"(?i)\b(?:infirmary|clin[i1l]c|hospital|ward|house|home|ha[l1i]{2}|dispensary|laboratory|centre|center|institute|school|street|road|lane|avenue|row|close|way|hill|ledger|book|record|register|notes|room|desk|the|at|of|and|was|is|for|with|in|on|to|by|no|page|after|from|table|tr|td)\b"
)


#: Words of a person's role before a name, what persons do after it, and titles.
ROLE = re.compile(r"(?i)\b(?:patient|name|named|signed|witness(?:ed)?|nurse|doctor|surgeon|informant|mother|father|wife|husband|daughter|son|brother|sister|widow|kin|contact|attended by|seen by|accompanied by|brought by|reported by|written by|dear)\b[:,]?\s+$")
TITLE_BEFORE = re.compile(r"(?<![^\W_])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Pt|Sr|Herr|Frau|Dra|Don|Doña)\b\.?\s+$")
DOES = re.compile(r"\s+(?:said|says|asked|told|agreed|refused|signed|complains|complained|reports|reported|lives|lived|wishes|wrote|writes|died|was born|was admitted|was discharged)\b")
SHAPE = re.compile(r"(?<![\w@.'’-])(?=((?:[A-Z][a-z]+(?:['’-][A-Z]?[a-z]+)?|[A-Z]\.)(?:[^\S\n]+[A-Z]\.)?[^\S\n]+(?:[A-Z]['’])?[A-Z][a-z]+(?:-[A-Z][a-z]+)?(?![\w@])))[A-Z]")  # from every word on: the first of a sentence is no given name


def emails(text: str) -> Iterator[Span]:
    if not re.search(r"[@＠]|\bat\b|[\[({]at", text, re.IGNORECASE):
        return
    for m in EMAIL.finditer(text):
        yield Span(m.start(), m.end(), "email", 0.95)


def phones(text: str) -> Iterator[Span]:
    if not SIX_DIGITS.search(text):
        return
    for m in PHONE.finditer(text):
        raw = m[0]
        number = re.split(r"(?i)\s*,?\s*(?:ext|x)", raw)[0]
        size = len(re.sub(r"[^\dOo]", "", number))
        if not 7 <= size <= 15 or sum(c.isdigit() for c in number) < 6:
            continue
        before = text[max(0, m.start() - 45) : m.start()]
        score = 0.3
        if PHONE_LABEL.search(before):
            score += 0.5
        if PHONE_STRONG.match(number):
            score += 0.25
        if ID_LABEL.search(before):
            score -= 0.5
        if ID_OTHER.search(before):
            score -= 0.5
        yield Span(m.start(), m.end(), "phone", score)


def id_numbers(text: str) -> Iterator[Span]:
    if not SIX_DIGITS.search(text):
        return
    refused: list[tuple[int, int]] = []  # the forms further down have no say about these
    for pattern, base, check in ID_FORMATS:
        for m in pattern.finditer(text):
            if any(m.start() < e and s < m.end() for s, e in refused):
                continue
            answer = check(m[0])
            if answer is False:
                refused.append(m.span())
            before = text[max(0, m.start() - 45) : m.start()]
            score = base + CHECKED[answer]
            if ID_LABEL.search(before):
                score += 0.45
            if PHONE_LABEL.search(before):
                score -= 0.4
            if ID_OTHER.search(before) and not re.search(r"(?i)card|licen|passport|nation", before[-25:]):
                score -= 0.6
            yield Span(m.start(), m.end(), "id_number", score)


def addresses(text: str) -> Iterator[Span]:
    for m in ADDRESS.finditer(text):
        end = m.end()
        group = "town" if m["town"] else "ort"
        town, at = m[group], m.end(group)
        words = re.split(r"\s", town)
        # the town's second word may be the first of a new sentence: then small letters follow it
        if len(words) == 2 and not m["code"]:
            tail = text[at : at + 30]
            upper = words[0].isupper() and len(words[0]) > 1
            if (upper and not words[1].isupper()) or (not upper and re.match(r"\s[a-z]", tail)):
                end = m.start(group) + len(words[0])
        yield Span(m.start(), end, "address", 0.9)


def cued_names(text: str) -> Iterator[Span]:
    """Names at the places where forms and sentences name a person, in any case and order."""
    for m in NAME_BEFORE.finditer(text):
        if not NO_NAME.search(m["name"]):
            yield Span(m.start("name"), m.end("name"), "name", 0.9)
    for cue in AFTER.finditer(text):
        begin = max(0, cue.start() - LONGEST_NAME)
        m = NAME_AT_END.search(text[begin : cue.start()])
        if m and not NO_NAME.search(m["name"]):
            yield Span(begin + m.start("name"), cue.start(), "name", 0.9)
    for m in NAME_IN_HEAD.finditer(text):
        if NO_NAME.search(m["name"]):
            continue
        begin = text.rfind("\n", 0, m.start("name")) + 1
        if text[max(0, begin - 2) : begin].strip("\n") or not re.match(r"[^\n]*(?:\n[^\S\n]*(?:\n|$)|$)", text[m.end("name") :]):
            continue  # a head is a line of its own
        if not NO_NAME.search(text[begin : m.start("name")]) or re.search(r"(?i)\b(?:e-?mail|te[l1]|phone|fax|no)\b\W*$", text[begin : m.start("name")]):
            continue
        yield Span(m.start("name"), m.end("name"), "name", 0.8)


def name_words(name: str) -> frozenset[str]:
    return frozenset(w.casefold() for w in re.findall(r"[^\W\d_]{2,}", name))


def names(text: str) -> Iterator[Span]:
    """Cued names, and others by their shape: what stands around them, or another mention, makes them persons."""
    cued = list(cued_names(text))
    yield from cued
    known = {name_words(text[s.start : s.end]) for s in cued}
    for m in SHAPE.finditer(text):
        if NO_NAME.search(m[1]) or NO_NAME.match(text, m.end(1) + 1):
            continue
        before = text[max(0, m.start() - 40) : m.start()]
        score = 0.25
        if TITLE_BEFORE.search(before):
            score += 0.35
        if ROLE.search(before):
            score += 0.2
        if DOES.match(text, m.end(1)):
            score += 0.2
        if name_words(m[1]) in known:
            score += 0.4
        yield Span(m.start(), m.end(1), "name", score)


def mentions(text: str | None) -> list[Span]:
    """All mentions of one text, in order, none overlapping."""
    if not text:
        return []
    found = [s for f in (emails, phones, id_numbers, addresses, names) for s in f(text) if s.score >= THRESHOLD]
    found.sort(key=lambda s: (-round(s.score, 3), s.start - s.end, s.start, s.kind))
    kept: list[Span] = []
    for s in found:
        if all(s.end <= k.start or s.start >= k.end for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s.start)


def redacted(text: str | None) -> str | None:
    """The same text with ``[KIND]`` for each mention and all else unchanged."""
    if text is None:
        return None
    out, at = [], 0
    for s in mentions(text):
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*out, text[at:]])


# --- Spark ---------------------------------------------------------------------------------------


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """``field, record_id, block_id, text`` of the two fields, each delivery and each block once; blocks are exploded in the JVM."""
    from ..sources.tables import first_deliveries, nested_table

    run = nested_table(spark, folder, "payload", ["export_id", "parsing_run.id", "parsing_run.markdown_text"])
    run = first_deliveries(run.select("export_id", F.col("parsing_run.id").alias("record_id"), F.col("parsing_run.markdown_text").alias("text")), "record_id", "export_id")
    one = run.select(F.lit("payload_markdown").alias("field"), "record_id", F.lit("").alias("block_id"), "text")
    vl = nested_table(spark, folder, "prescription_vl_result", ["result_id", "received_at", "pages.blocks.block_id", "pages.blocks.content"])
    blocks = F.transform(F.filter("pages", lambda p: p.blocks.isNotNull()), lambda p: p.blocks)
    blocks = F.array_distinct(F.filter(F.flatten(blocks), lambda b: b.content.isNotNull()))  # a block given twice
    each = first_deliveries(vl, "result_id", "received_at").select("result_id", F.explode(blocks).alias("b"))
    two = each.select(F.lit("vl_content").alias("field"), F.col("result_id").alias("record_id"), F.col("b.block_id").alias("block_id"), F.col("b.content").alias("text"))
    return one.unionByName(two).where(F.col("text").isNotNull() & (F.col("text") != ""))


def _map(df: DataFrame, schema: str, work: Callable[[tuple], Iterable[tuple]]) -> DataFrame:
    names_ = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int32() if c.endswith(" int") else pa.string() for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for row in zip(*(c.to_pylist() for c in batch.columns)) for r in work(row)]
            columns = list(zip(*rows)) if rows else [[] for _ in names_]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names_)

    return df.mapInArrow(run, schema)


def found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per mention."""
    from ..session import spread, wide_batches

    wide_batches(spark)
    rows = lambda r: [(r[0], r[1], r[2], s.start, s.end, s.kind) for s in mentions(r[3])]
    return _map(spread(texts(spark, folder)), "field string, record_id string, block_id string, start_pos int, end_pos int, pii_type string", rows).distinct()


def redact(spark: SparkSession, folder: str) -> DataFrame:
    """Both fields with placeholders for the mentions."""
    from ..session import spread, wide_batches

    wide_batches(spark)
    return _map(spread(texts(spark, folder)), "field string, record_id string, block_id string, text string", lambda r: [(r[0], r[1], r[2], redacted(r[3]))])


QUERIES = {"p5_found": found, "p5_redacted": redact}
SQL: dict[str, str] = {}
