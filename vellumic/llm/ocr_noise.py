"""Text of scanned pages repaired into readable paragraphs (problem 4).

1. Words, hyphenated compounds, neighbouring pairs and the possible joins of words split at a line end are counted over all
   records, in Python and then in Spark. A word of ``LEAST`` occurrences is vocabulary, however large the corpus.
2. Candidates: a Levenshtein automaton of a read word is intersected with a trie of the vocabulary. Confusions of character
   shapes (substitutions, merges such as rn/m and splits such as d/cl) cost one, any other substitution, insertion and
   deletion two; all words within ``MAX_EDITS`` are found, none missed. Each different word is looked up once. The vocabulary is
   sharded by the outline of its words, which no confusion changes, so a task holds the trie of one shard.
3. Ranking: by edits and frequency, in a repair also by the word before. A read word is misread if a candidate by confusions alone
   is far more frequent (or the read word is no vocabulary).
4. Page furniture: lone lines that return at the same edge of several pages, and page numbers; in a prediction, lines at its
   edge that return in other predictions.
5. Words split over a line end are joined, across page furniture and tables too; lines are reflowed into paragraphs.

The answers go back to the records as a broadcast while there are at most ``ANSWERS`` of them, else by a join of each record's
own questions; the results are the same. An evaluation's ground truth says only which lines and words of its
prediction are not as printed; candidates come from the corpus. The repair does not look at it.

Defined results: null and empty texts have no noise and stay as they are; null pages and blocks are
skipped; texts are processed whole; rows delivered twice give one set of rows. One record is worked on in one task.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lookalike

#: Shapes that recognisers take for each other, as (printed, read).
CONFUSIONS = [
    ("e", "c"), ("c", "e"), ("o", "0"), ("0", "o"), ("d", "cl"), ("cl", "d"), ("i", "l"), ("l", "i"), ("l", "1"), ("1", "l"), ("i", "1"), ("1", "i"),
    ("n", "u"), ("u", "n"), ("t", "f"), ("f", "t"), ("h", "b"), ("b", "h"), ("s", "5"), ("5", "s"), ("b", "6"), ("6", "b"), ("w", "vv"), ("vv", "w"),
    ("g", "9"), ("9", "g"), ("q", "9"), ("m", "rn"), ("rn", "m"), ("m", "nn"), ("nn", "m"), ("y", "v"), ("v", "y"), ("u", "ii"), ("ii", "u"), ("n", "ii"), ("2", "z"), ("z", "2"),
    ("in", "m"), ("m", "in"), ("1", "7"), ("7", "1"), ("4", "9"), ("9", "4"), ("3", "8"), ("8", "3"), ("5", "6"), ("6", "5"), ("0", "6"), ("6", "0"), ("8", "b"), ("b", "8"),
    ("li", "h"), ("h", "li"), ("ri", "n"), ("n", "ri"),
]
#: Marks that split a word at a line end.
BREAKS = "-\u00ad\u2010\u2011\u00ac"
_MARKS = tuple(BREAKS)

LEAST = 3  # occurrences of a vocabulary word
RATIO = 40  # a vocabulary word so much rarer than a candidate is a misreading of it, too
RATIO_READ = 20  # the same among predictions, which are read worse
MAX_EDITS = 3
PLAIN = 2  # cost of an edit that is no confusion
PROSE = 4  # words of a line that is neither furniture nor table
REACH = 3  # paragraphs of prose that a broken word may be continued after, out of order as blocks come
HEADS = 2  # predictions that a head at their edge returns in
ANSWERS = 1_000_000  # rows that every task may hold
SHORT, PARTS = 4, 8  # outlines of fewer signs than this are spread over so many shards

WORD = re.compile(r"[^\W_]+")
COMPOUND = re.compile(r"[^\W_]+(?:-[^\W_]+)+")
MAIL = re.compile(r"(?<!\S)[^\s@\uff20]*[@\uff20]\S*|(?<!\S)[^\s\[]+\[at\]\S*|https?:\S+|<[^<>]*>")
BREAK_AT_END = re.compile(rf"(?<![^\W\d_])([^\W\d_]+)[{BREAKS}]\s*$")
_ROMAN = r"[ivxlcl1]{1,6}"
_NUMBER = r"[\dOolIZSB]{1,4}"
PAGE_NUMBER = re.compile(
    rf"^\W*(?:(?:p[a\u00e1]?[g9][ec]|p[gp]?|fol(?:io)?|f[o0][l1]|seite|s|p\u00e1gina|p\u00e1g|blatt|leaf|sheet)\W*)?(?:{_NUMBER}|{_ROMAN})(?:\s*(?:/|[o0]f|von|de)\s*{_NUMBER})?\W*$", re.IGNORECASE
)

_SINGLE, _SEVERAL = lookalike.shape_map()
_INVISIBLE = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), lookalike.INVISIBLE) + "]")
_SPACES = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), lookalike.SPACES) + "]")
_SHAPES = _SINGLE | _SEVERAL
_SHAPED = re.compile("[" + "".join(map(re.escape, _SHAPES)) + "]")


def plain(text: str) -> str:
    """The look-alike form of problem 3, for comparing; a soft hyphen at a line end is kept."""
    if text.isascii():
        return text
    text = re.sub("\u00ad(?=[ ]*(\n|$))", "\u00ac", text)
    text = unicodedata.normalize("NFC", _SPACES.sub(" ", _INVISIBLE.sub("", text)))
    return unicodedata.normalize("NFC", _SHAPED.sub(lambda m: _SHAPES[m[0]], text))


def break_at_end(text: str) -> re.Match | None:
    """The part of a word before a splitting mark at the line's end."""
    return BREAK_AT_END.search(text) if text.rstrip()[-1:] in _MARKS else None


class Trie:
    """A vocabulary, searched by automata."""

    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = w

    def candidates(self, read: str, most: int = MAX_EDITS, plain_edits: bool = False) -> dict[str, tuple[int, tuple[int, ...] | None]]:
        """All other words of the trie from which ``read`` arises at a cost of ``most``: word -> (cost, places in ``read``; None if not by confusions alone)."""
        out: dict[str, tuple[int, tuple[int, ...] | None]] = {}
        n = len(read)
        # trie node, characters read, cost, places of confusions (None: a plain edit was made): a state of the automaton
        todo: list[tuple[dict, int, int, tuple[int, ...] | None]] = [(self.root, 0, 0, ())]
        while todo:
            node, i, cost, places = todo.pop()
            if i == n and (w := node.get("")) is not None and (w not in out or (cost, places is None) < (out[w][0], out[w][1] is None)):
                out[w] = (cost, places)
            if i < n and (to := node.get(read[i])) is not None:
                todo.append((to, i + 1, cost, places))
            if cost < most and i < n:
                for printed, part in BY_READ.get(read[i], ()):
                    if read.startswith(part, i):
                        to = node
                        for c in printed:
                            to = to.get(c)
                            if to is None:
                                break
                        else:
                            todo.append((to, i + len(part), cost + 1, None if places is None else (*places, i)))
            if plain_edits and cost + PLAIN <= most:
                if i < n:
                    todo.append((node, i + 1, cost + PLAIN, None))
                for c, to in node.items():
                    if c:
                        todo.append((to, i, cost + PLAIN, None))
                        if i < n and c != read[i]:
                            todo.append((to, i + 1, cost + PLAIN, None))
        out.pop(read, None)
        return out


BY_READ: dict[str, list[tuple[str, str]]] = {}
for _printed, _read in CONFUSIONS:
    BY_READ.setdefault(_read[0], []).append((_printed, _read))
#: What is left of a character's shape by all confusions: most are strokes, of which only runs are told.
_OUTLINE = dict.fromkeys("il17rnumhb60o5s83", "|") | {"e": "c", "c": "c", "t": "t", "f": "t", "y": "v", "v": "v", "w": "vv", "g": "g", "9": "g", "q": "g", "4": "g", "2": "z", "z": "z", "d": "c|"}


def outline(word: str) -> str:
    """The same for all words that confusions make of each other."""
    return re.sub(r"\|+", "|", "".join(_OUTLINE.get(c, c) for c in word))


def outlines(word: str) -> set[str]:
    """Its own outline and those without one character: words that differ by one plain edit share one of them."""
    return {outline(word), *(outline(word[:i] + word[i + 1 :]) for i in range(len(word)))}


_DIGITS = re.compile(r"[\dol]{3,}")


def number_of(read: str) -> tuple[str, tuple[int, ...]] | None:
    """A number in which letters stand for digits."""
    if sum(ch.isdigit() for ch in read) >= 2 and _DIGITS.fullmatch(read) and not read.isdigit():
        return "".join({"o": "0", "l": "1"}.get(ch, ch) for ch in read), tuple(i for i, ch in enumerate(read) if not ch.isdigit())
    return None


@dataclass
class Answers:
    """What the corpus says about the words of a record."""

    fixes: dict[str, tuple[str, tuple[int, ...]]] = field(default_factory=dict)  # misread word -> printed word, places
    whole: dict[str, int] = field(default_factory=dict)  # joined word -> its count
    hyphened: dict[str, int] = field(default_factory=dict)  # compound -> its count
    pairs: dict[str, str] = field(default_factory=dict)  # "before read" -> the printed word that fits there
    candidates: dict[str, dict[str, tuple[int, ...]]] = field(default_factory=dict)  # read word of a prediction -> words it may be
    heads: set[str] = field(default_factory=set)

    def misread(self, read: str, before: str = "") -> tuple[str, tuple[int, ...]] | None:
        """The printed word and the places of its misread characters, or None if the word stands."""
        if len(read) < 2 or read.isdigit():
            return None
        got = self.fixes.get(read) if read.isalpha() else number_of(read) or self.fixes.get(read)
        return got and (self.pairs.get(f"{before} {read}", got[0]), got[1])

    @classmethod
    def of(cls, rows: Iterable[tuple[str, str, str | None, int | None, list[int] | None, list[dict] | None]]) -> Answers:
        """From (kind, asked, printed, n, places, candidates)."""
        out = cls()
        for kind, asked, printed, n, places, candidates in rows:
            if kind == "word":
                out.fixes[asked] = (printed, tuple(places or ()))
            elif kind == "join":
                out.whole[asked] = n
                if printed is not None:
                    out.fixes.setdefault(asked, (printed, tuple(places or ())))
            elif kind == "compound":
                out.hyphened[asked] = n
            elif kind == "pair":
                out.pairs[asked] = printed
            elif kind == "head":
                out.heads.add(asked)
            elif kind == "candidates":
                out.candidates[asked] = {c["word"]: tuple(c["places"]) for c in candidates}
        return out


@dataclass
class Line:
    block: str
    no: int
    text: str
    para: int
    page: int | None = None
    kinds: set[str] = field(default_factory=set)
    joins: tuple[Line, str, str] | None = None  # the line that goes on, the word's two parts
    fixes: list[tuple[str, str]] = field(default_factory=list)


def lines_of(text: str, block: str = "", first_para: int = 0, page: int | None = None) -> list[Line]:
    out, para = [], first_para
    for no, line in enumerate(text.split("\n")):
        if not line.strip():
            para += 1
        out.append(Line(block, no, line, para, page))
    return out


def head_key(text: str) -> str:
    """A head without its page number, case and punctuation."""
    return re.sub(r"[\W\d_]+", " ", re.sub(rf"^\s*{_NUMBER}\s\s+|\s\s+{_NUMBER}\s*$", "", plain(text))).strip().casefold()


def same_head(a: str, b: str) -> bool:
    """Equal but for misreadings."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 4 or min(len(a), len(b)) < 4:
        return False
    budget = max(1, len(a) // 8)
    rows = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, rows[0] = rows[0], i
        for j, y in enumerate(b, 1):
            last, rows[j] = rows[j], min(rows[j] + 1, rows[j - 1] + 1, last + (x != y))
        if min(rows) > budget:
            return False
    return rows[-1] <= budget


def lone_lines(lines: list[Line]) -> list[Line]:
    filled = Counter(x.para for x in lines if x.text.strip())
    return [x for x in lines if x.text.strip() and filled[x.para] == 1]


def edges(pages: list[list[str]]) -> list[set[tuple[str, str]]]:
    """Per page the keys of its first and last text that is no page number."""
    out = []
    for texts in pages:
        texts = [t for t in texts if t.strip() and not PAGE_NUMBER.match(plain(t))]
        found = set()
        for place, t in (("top", texts[0]), ("foot", texts[-1])) if texts else ():
            if "\n" not in t.strip():
                found.add((place, head_key(t)))
        out.append(found)
    return out


def repeated_heads(per_page: list[set[tuple[str, str]]], least: int = 2) -> list[str]:
    """Keys that stand at one place of several pages."""
    groups: list[tuple[str, str, set[int]]] = []
    for i, found in enumerate(per_page):
        for place, key in found:
            if not key:
                continue
            for p, k, seen in groups:
                if p == place and same_head(k, key):
                    seen.add(i)
                    break
            else:
                groups.append((place, key, {i}))
    return [k for _, k, seen in groups if len(seen) >= least]


def mark_furniture(lines: list[Line], heads: list[str]) -> None:
    for x in lone_lines(lines):
        if PAGE_NUMBER.match(plain(x.text)):
            x.kinds.add("page_number")
        elif heads:
            key = head_key(x.text)
            if any(same_head(h, key) for h in heads):
                x.kinds.add("running_head")


def without_mail(text: str, by: Callable[[re.Match], str] | str) -> str:
    """Addresses of mail and web and tags taken out; most texts have none."""
    return MAIL.sub(by, text) if "@" in text or "<" in text or "\uff20" in text or "[at]" in text or "http" in text else text


def body_of(lines: list[Line]) -> tuple[list[Line], list[str]]:
    """The lines that are no page furniture, and their comparable texts without addresses of mail and web."""
    body = [x for x in lines if x.text.strip() and not x.kinds]
    return body, [without_mail(plain(x.text), lambda m: " " * len(m[0])) for x in body]


def is_prose(text: str) -> bool:
    return not text.lstrip().startswith(("|", "<")) and len(text.split()) >= PROSE


def continuations(body: list[Line], texts: list[str], i: int, head: re.Match) -> Iterator[tuple[int, str, str, str]]:
    """Where the word that line i breaks off may go on: (line, rest, joined word, compound). Furniture and tables are passed over, and ``REACH`` paragraphs of prose."""
    first = head[1].casefold()
    chain = re.search(r"[^\W_]+(?:-[^\W_]+)*$", texts[i][: head.end(1)])[0].casefold()
    seen: set[int] = set()
    for j in range(i + 1, len(body)):
        if is_prose(texts[j]) and body[j].para != body[i].para:
            seen.add(body[j].para)
            if len(seen) > REACH:
                return
        text = texts[j].lstrip()
        n = WORD.match(text)
        if n and n[0].isalpha() and text[n.end() : n.end() + 1] != "@":
            rest = n[0].casefold()
            yield j, n[0], first + rest, f"{chain}-{rest}"


def mark_breaks(body: list[Line], texts: list[str], answers: Answers) -> dict[int, int]:
    """Marks broken words, takes their first parts from the texts, and tells how much of a line is the rest of one."""
    skip: dict[int, int] = {}
    for i, x in enumerate(body):
        m = break_at_end(texts[i])
        if not m:
            continue
        best: tuple[int, str] | None = None
        for j, rest, joined, compound in continuations(body, texts, i, m):
            whole, hyphened = answers.whole.get(joined, 0), answers.hyphened.get(compound, 0)
            if hyphened > whole:
                best = None
                break
            if whole:
                best = (j, rest)
                break
            if j == i + 1 and rest[:1].islower() and body[j].para == x.para:
                best = (j, rest)  # a word that is not in the vocabulary: the next line, unless a later one fits
        if best:
            j, rest = best
            x.kinds.add("broken_word")
            x.joins = (body[j], m[1], rest)
            skip[j] = len(rest)
            texts[i] = texts[i][: m.start()]
    return skip


def mark_words(lines: list[Line], answers: Answers) -> None:
    """Broken words and misreadings in the lines that are no page furniture."""
    body, texts = body_of(lines)
    skip = mark_breaks(body, texts, answers)
    for x in body:
        if x.joins:
            after, head, rest = x.joins
            got = answers.misread((head + rest).casefold())
            if got:
                word, places = got
                x.fixes.append((head + rest, word))
                if any(p < len(head) for p in places):
                    x.kinds.add("misread")
                if any(p >= len(head) for p in places):
                    after.kinds.add("misread")
    for x, before, read in words_of(body, texts, skip):
        got = answers.misread(read.casefold(), before)
        if got:
            x.kinds.add("misread")
            x.fixes.append((read, got[0]))


def words_of(body: list[Line], texts: list[str], skip: dict[int, int]) -> Iterator[tuple[Line, str, str]]:
    """(line, the word before in it, word), without the parts of broken words."""
    for i, x in enumerate(body):
        text = texts[i]
        if i in skip:
            text = text[len(text) - len(text.lstrip()) + skip[i] :]
        before = ""
        for word in WORD.findall(text):
            yield x, before, word
            before = word.casefold()


BROKEN_PARTS = re.compile(rf"(?<![^\W_])(?:[^\W_]+-)*[^\W\d_]+[{BREAKS}][^\S\n]*\n\s*[^\W_]*")


def count_words(text: str, pairs: bool = True) -> tuple[list[str], list[str], list[str]]:
    """Whole words, compounds and, if asked for, pairs of one text; words split over a line end are left out."""
    text = without_mail(plain(text).casefold(), " ")
    if "\n" in text:
        text = BROKEN_PARTS.sub(" ", text)
    words = WORD.findall(text)
    return words, COMPOUND.findall(text) if "-" in text else [], [f"{a} {b}" for a, b in zip(words, words[1:])] if pairs else []


def corrected(word: str, printed: str) -> str:
    return printed.upper() if word.isupper() and len(word) > 1 and not printed.isdigit() else printed[:1].upper() + printed[1:] if word[:1].isupper() else printed


def reflow(lines: list[Line]) -> str:
    """The text without page furniture, with words joined and corrected, one line per paragraph."""
    took: dict[int, int] = {id(x.joins[0]): len(x.joins[2]) for x in lines if x.joins}
    paragraphs: list[str] = []
    at: int | None = None
    for x in lines:
        if x.kinds & {"running_head", "page_number"} or not x.text.strip():
            continue
        text = x.text
        if id(x) in took:
            text = text.lstrip()[took[id(x)] :]
        text = text.strip()
        if x.joins:
            text = BREAK_AT_END.sub(lambda m: m[1], text) if break_at_end(text) else text.rstrip(BREAKS + " ")
            text += x.joins[2]
        for read, printed in x.fixes:
            text = re.sub(rf"(?<!\w){re.escape(read)}(?!\w)", lambda m, p=printed: corrected(m[0], p), text)
        if not text:
            continue
        if at == x.para and paragraphs:
            close = (text[0] in ".,;:!?)" and id(x) in took) or re.search(r"[^\W_]-$", paragraphs[-1])  # a compound keeps its hyphen
            paragraphs[-1] += ("" if close else " ") + text
        elif id(x) in took and paragraphs and text[0] in ".,;:!?)":
            paragraphs[-1] += text
        else:
            paragraphs.append(text)
        at = x.para
    return "\n\n".join(paragraphs)


# --- whole records -------------------------------------------------------------------------------


def markdown_lines(text: str, pages: list | None, page_count: int | None) -> list[Line]:
    """A run's text; its pages, as far as they are there, say what stands at a page's edge."""
    lines = lines_of(text)
    per_page = edges([[b for b in p or [] if b] for p in pages or []])
    heads = repeated_heads(per_page)
    whole = sum(1 for found in per_page if found)
    if whole < (page_count or 2):  # pages are missing: what returns in the text and stands at one edge, or looks like a head
        seen: list[tuple[str, int, Line]] = []
        for x in lone_lines(lines):
            key = head_key(x.text)
            if not key or PAGE_NUMBER.match(plain(x.text)):
                continue
            for i, (k, n, first) in enumerate(seen):
                if same_head(k, key):
                    seen[i] = (k, n + 1, first)
                    break
            else:
                seen.append((key, 1, x))
        at_edge = [k for found in per_page for _, k in found]
        for k, n, first in seen:
            sentence = first.text.rstrip()[-1:] in ".!?:;,)>" or break_at_end(first.text)
            if n >= 2 and not sentence and (not per_page or not whole or any(same_head(k, e) for e in at_edge)) and len(k.split()) >= 3:
                heads.append(k)
    mark_furniture(lines, heads)
    return lines


def block_lines(pages: list | None) -> list[Line]:
    """The blocks of a result; ``pages``: (page_index, [(block_id, content)]) as stored, parts may be null."""
    order = sorted((p for p in enumerate(pages or []) if p[1] is not None), key=lambda p: (p[1][0] if p[1][0] is not None else p[0], p[0]))
    lines: list[Line] = []
    texts: list[list[str]] = []
    for no, (_, (_, blocks)) in enumerate(order):
        given, texts_here = set(), []
        for block in blocks or []:
            if block is None or block[1] is None or tuple(block) in given:
                continue
            given.add(tuple(block))
            texts_here.append(block[1])
            lines += lines_of(block[1], block[0], lines[-1].para + 1 if lines else 0, no)
        texts.append(texts_here)
    mark_furniture(lines, repeated_heads(edges(texts)))
    return lines


@lru_cache(5000)
def truth_words(truth: str | None) -> tuple[Counter, frozenset[str]]:
    """The words and the lines of a ground truth."""
    truth = plain(truth or "")
    return Counter(w.casefold() for w in WORD.findall(truth)), frozenset(x.strip().casefold() for x in truth.split("\n"))


def prediction_lines(prediction: str, truth: str | None, answers: Answers | None = None) -> list[Line]:
    """The lines of a prediction, with what its ground truth lacks of page furniture marked."""
    if "\n" not in prediction:
        return [Line("", 0, prediction, 0)]
    lines = lines_of(prediction)
    if len(lines) > 1:
        words, whole = truth_words(truth)
        filled = [x for x in lines if x.text.strip()]
        for x in filled:
            text = plain(x.text)
            tokens = [w.casefold() for w in WORD.findall(text)]
            if not tokens or text.strip().casefold() in whole:
                continue
            if PAGE_NUMBER.match(text):
                x.kinds.add("page_number")
            elif x in (filled[0], filled[-1]) and len(head_key(x.text).split()) >= 3 and sum(t in words for t in tokens) < 0.5 * len(tokens):
                if truth is None and (not any(t.isdigit() for t in tokens) or break_at_end(text) or x is not filled[0] and break_at_end(plain(filled[-2].text))):
                    continue  # nothing says what is printed: a head has a number, and no word runs on into it or out of it
                x.kinds.add("running_head" if answers and head_key(x.text) in answers.heads else "perhaps_head")
    return lines


def unmarked(lines: list[Line]) -> list[Line]:
    """Lines that are no heads after all."""
    for x in lines:
        x.kinds.discard("perhaps_head")
    return lines


def mark_prediction(lines: list[Line], truth: str, answers: Answers) -> None:
    """Words that the ground truth lacks and that may be misreadings of words it has besides: an exact check of the corpus' candidates."""
    if len(lines) == 1:
        _mark_missing([(w, [(lines[0], 0)]) for w in WORD.findall(without_mail(plain(lines[0].text), " ").casefold())], truth, answers)
        return
    body, texts = body_of(unmarked(lines))
    skip = mark_breaks(body, texts, answers)
    read: list[tuple[str, list[tuple[Line, int]]]] = []  # word, lines and first places in it
    for x in body:
        if x.joins:
            read.append(((x.joins[1] + x.joins[2]).casefold(), [(x, 0), (x.joins[0], len(x.joins[1]))]))
    read += [(w.casefold(), [(x, 0)]) for x, _, w in words_of(body, texts, skip)]
    _mark_missing(read, truth, answers)


def _mark_missing(read: list[tuple[str, list[tuple[Line, int]]]], truth: str, answers: Answers) -> None:
    words, _ = truth_words(truth)
    missing = dict(words)
    for w, _ in read:
        missing[w] = missing.get(w, 0) - 1
    if not any(n > 0 for n in missing.values()):
        return  # nothing that is printed is missing
    for word, places in read:
        if word in words and missing[word] >= 0:
            continue
        found = answers.candidates.get(word, {})
        fits = [w for w in found if missing.get(w, 0) > 0]
        if not fits:
            continue
        best = min(fits, key=lambda w: (len(found[w]), w))
        missing[best] -= 1
        missing[word] += word in words
        for k, (line, first) in enumerate(places):
            end = places[k + 1][1] if k + 1 < len(places) else len(word)
            if any(first <= p < end for p in found[best]):
                line.kinds.add("misread")


# --- questions and answers over the corpus -------------------------------------------------------

ANSWER = "space string, kind string, asked string, printed string, n long, places array<int>, candidates array<struct<word:string,places:array<int>>>"
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}


def record_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(c.split(" ") for c in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(columns, types)], names=list(names))


def each_row(df: DataFrame, schema: str, work: Callable[[dict], Iterable[tuple]]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                yield record_batch([out for row in batch.slice(start, 1000).to_pylist() for out in work(row)], schema)

    return df.mapInArrow(run, schema)


def lines_in(kind: str, row: dict, truth: bool, answers: Answers | None = None) -> list[Line]:
    """The lines of a record with its page furniture marked."""
    if kind == "payload_markdown":
        return markdown_lines(row["text"], row["pages"], row["page_count"])
    if kind == "vl_content":
        return block_lines([None if p is None else (p["page_index"], [None if b is None else (b["block_id"], b["content"]) for b in p["blocks"] or []]) for p in row["pages"] or []])
    return prediction_lines(row["text"], row["truth"] if truth else None, answers)


def questions(kind: str, row: dict, truth: bool) -> Iterator[tuple[str, list[str]]]:
    """What a record counts for and asks: a kind and strings. ``truth``: whether ground truths may be looked at."""
    if kind == "truth":
        words, compounds, _ = count_words(row["text"], False)
        yield "printed", words
        yield "compound", compounds
        return
    printed = truth_words(row["truth"])[0] if kind == "prediction" and truth else {}
    names = ("word", "compound") if truth else ("word", "compound", "pair")  # pairs are for the best candidate only
    if kind == "prediction" and "\n" not in row["text"]:  # one line: no furniture and no word is split
        for name, found in zip(names, count_words(row["text"], not truth)):
            yield name, [w for w in found if w not in printed] if printed else found
        return
    lines = lines_in(kind, row, truth)
    given: dict[str, list[str]] = {}
    for x in lines:
        given.setdefault(x.block, []).append(x.text)
    for text in given.values():
        for name, found in zip(names, count_words("\n".join(text), not truth)):
            yield name, [w for w in found if w not in printed] if printed else found
    body, texts = body_of(unmarked(lines))
    for i in range(len(body)):
        m = break_at_end(texts[i])
        if m:
            asked = list(continuations(body, texts, i, m))
            yield "ask_join", [x[2] for x in asked]
            yield "ask_compound", [x[3] for x in asked]


COUNTED = "space string, kind string, asked string, n long"


def counts(parts: dict[str, DataFrame], truth: bool) -> DataFrame:
    """All questions of all records with how often each is put, added up in Python before they are shuffled."""

    def one(kind: str, df: DataFrame) -> DataFrame:
        space = space_of(kind)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, Counter] = {}

            def flush() -> pa.RecordBatch:
                rows = [(space, name, w, n) for name, c in sums.items() for w, n in c.items()]
                sums.clear()
                return record_batch(rows, COUNTED)

            for batch in batches:
                for start in range(0, batch.num_rows, 1000):
                    for row in batch.slice(start, 1000).to_pylist():
                        for name, strings in questions(kind, row, truth):
                            sums.setdefault(name, Counter()).update(strings)
                if sum(map(len, sums.values())) > 300_000:
                    yield flush()
            yield flush()

        return df.mapInArrow(run, COUNTED)

    every = reduce(DataFrame.unionByName, [one(k, df) for k, df in parts.items()])
    return every.groupBy("space", "kind", "asked").agg(F.sum("n").alias("n"))


def space_of(kind: str) -> str:
    return "prediction" if kind in ("prediction", "truth") else "scan"


KEYED = "space string, key string, part int, side int, word string, n long, wide boolean"
FOUND = "space string, read string, n_read long, word string, n long, cost int, places array<int>"


def lookup(reads: DataFrame, vocabulary: DataFrame, most: int = MAX_EDITS) -> DataFrame:
    """``FOUND``: every vocabulary word that a read word may be, at a cost of ``most``.

    ``reads``: space, word, n, wide (whether plain edits are made, too); ``vocabulary``: space, word, n. Words meet by their outlines,
    which no confusion changes, or by those without one character, which one plain edit leaves alike. Of short outlines the
    vocabulary is spread over ``PARTS`` shards, each of which gets the reads.
    """

    def keys(side: int) -> Callable[[dict], Iterator[tuple]]:
        def work(row: dict) -> Iterator[tuple]:
            for key in outlines(row["word"]) if row["wide"] else {outline(row["word"])}:
                parts = range(1) if len(key) >= SHORT else range(PARTS) if side else [zlib.crc32(row["word"].encode()) % PARTS]
                for part in parts:
                    yield row["space"], key, part, side, row["word"], row["n"], row["wide"]

        return work

    columns = ["space", "word", "n"]
    both = each_row(vocabulary.select(*columns, F.lit(True).alias("wide")), KEYED, keys(0)).unionByName(each_row(reads.select(*columns, "wide"), KEYED, keys(1)))
    order = ["space", "key", "part", "side"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words, trie = None, {}, None
        for batch in batches:
            out = []
            for space, key, part, side, word, n, wide in zip(*(c.to_pylist() for c in batch.columns)):
                if (space, key, part) != at:
                    at, words, trie = (space, key, part), {}, None
                if not side:
                    words[word] = n
                elif words and (len(words) > 1 or word not in words):
                    trie = trie or Trie(words)
                    out += [(space, word, n, w, words[w], cost, None if places is None else list(places)) for w, (cost, places) in trie.candidates(word, most, wide).items()]
            yield record_batch(out, FOUND)

    hits = both.repartition(*order[:3]).sortWithinPartitions(*order).mapInArrow(run, FOUND)
    best = F.min(F.struct("cost", F.col("places").isNull().alias("plain"), "places")).alias("b")
    return hits.groupBy("space", "read", "n_read", "word", "n").agg(best).select("space", "read", "n_read", "word", "n", "b.cost", "b.places")


def rank() -> Column:
    return F.log(F.col("n") + 1) - 3 * F.col("cost")


def corpus_answers(counted: DataFrame, truth: bool, heads: DataFrame | None = None) -> DataFrame:
    """``ANSWER`` rows for all questions that have one."""
    of = lambda *kinds: counted.where(F.col("kind").isin(*kinds))
    number = F.length(F.regexp_replace("word", r"\P{Nd}", "")) > F.length(F.regexp_replace("word", r"\p{Nd}", ""))  # and codes: mostly digits
    weight = F.when(F.col("kind") == "printed", F.greatest(F.col("n"), F.lit(LEAST))).otherwise(F.col("n"))  # a printed word is known
    words = of("word", "printed").groupBy("space", F.col("asked").alias("word")).agg(F.sum(weight).alias("n"))
    known = words.where(F.col("n") >= LEAST)
    asked = words.unionByName(of("ask_join").select("space", F.col("asked").alias("word"), F.lit(0).cast("long").alias("n"))).groupBy("space", "word").agg(F.max("n").alias("n"))
    reads = asked.where((F.length("word") > 1) & ~number).withColumn("wide", F.col("n").between(1, LEAST - 1) & (F.length("word") > 3))  # joins that nobody wrote are no words
    cands = lookup(reads, known.where(~number))
    ratio = F.when(F.col("space") == "prediction", RATIO_READ).otherwise(RATIO)
    trusted = (F.col("n_read") < LEAST) | (F.col("b.n") >= ratio * F.col("n_read"))
    by_shape = cands.where("places IS NOT NULL").withColumn("rank", rank())
    fixes = by_shape.groupBy("space", "read", "n_read").agg(F.max(F.struct("rank", "word", "n", "places")).alias("b")).where(trusted)
    none = F.lit(None)
    row = lambda kind, asked, printed=none, n=none, places=none, candidates=none: [
        "space", F.lit(kind).alias("kind"), F.col(asked).alias("asked"), *[c.cast(t).alias(name) for c, t, name in ((printed, "string", "printed"), (n, "long", "n"), (places, "array<int>", "places"), (candidates, "array<struct<word:string,places:array<int>>>", "candidates"))],
    ]
    out = [fixes.select(*row("word", "read", F.col("b.word"), F.col("b.n"), F.col("b.places")))]
    joins = of("ask_join").select("space", F.col("asked").alias("word")).join(known, ["space", "word"], "left").join(fixes.select("space", F.col("read").alias("word"), "b"), ["space", "word"], "left")
    out.append(joins.where("n IS NOT NULL OR b IS NOT NULL").select(*row("join", "word", F.col("b.word"), F.coalesce("n", "b.n"), F.col("b.places"))))
    compounds = of("compound").groupBy("space", F.col("asked").alias("word")).agg(F.sum("n").alias("n")).where(F.col("n") >= (1 if truth else LEAST))
    ask = of("ask_compound").select("space", F.col("asked").alias("word"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("wide"))
    near = lookup(ask, compounds, 2).groupBy("space", F.col("read").alias("word")).agg(F.max("n").alias("near"))
    both = ask.select("space", "word").join(compounds, ["space", "word"], "left").join(near, ["space", "word"], "left")
    out.append(both.where("n IS NOT NULL OR near IS NOT NULL").select(*row("compound", "word", none, F.coalesce("n", "near"))))
    if truth:  # of a prediction's words all that a ground truth may have in their place
        printed = of("printed").select("space", F.col("asked").alias("word"), "n")
        said = of("word", "printed", "ask_join").where("space = 'prediction'").groupBy("space", F.col("asked").alias("word")).agg(F.max("n").alias("n")).withColumn("wide", F.lit(False))
        may = lookup(said, printed).groupBy("space", "read").agg(F.array_sort(F.collect_list(F.struct("word", "places"))).alias("c"))
        out.append(may.select(*row("candidates", "read", none, none, none, F.col("c"))))
    else:  # the word before says which candidate is read, where several are
        several = by_shape.join(fixes.select("space", "read"), ["space", "read"], "left_semi")
        several = several.join(several.groupBy("space", "read").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), ["space", "read"])
        pairs = of("pair").select("space", "asked", F.substring_index("asked", " ", 1).alias("before"), F.substring_index("asked", " ", -1).alias("read"), F.col("n").alias("together"))
        seen = pairs.where(F.col("together") >= LEAST).select("space", F.col("asked").alias("whole"))
        fit = pairs.join(several, ["space", "read"]).withColumn("whole", F.concat_ws(" ", "before", "word")).join(seen, ["space", "whole"])
        out.append(fit.groupBy("space", "asked").agg(F.max_by("word", F.struct("rank", "word")).alias("best")).select(*row("pair", "asked", F.col("best"))))
    # one character of another shape, in a repair also one lost or doubled: only where no confusion explains an unknown word of letters, and one word alone does
    same = F.length("read") == F.length("word")
    odd = cands.where(F.col("places").isNull() & F.col("n_read").between(1, LEAST - 1) & (F.col("n") >= RATIO) & F.col("read").rlike(r"^\p{L}+$") & (same if truth else F.lit(True)))
    odd = odd.join(fixes.select("space", "read"), ["space", "read"], "left_anti")
    alone = odd.groupBy("space", "read").agg(F.max("word").alias("word"), F.max("n").alias("n"), F.count(F.lit(1)).alias("many")).where("many = 1")
    apart = F.filter(F.sequence(F.lit(0), F.length("read") - 1), lambda i: F.substring("read", i + 1, 1) != F.substring("word", i + 1, 1))
    out.append(alone.select(*row("word", "read", F.col("word"), F.col("n"), F.when(same, apart).otherwise(F.array().cast("array<int>")))))
    if heads is not None:
        back = heads.where(F.col("n") >= HEADS).select(F.lit("prediction").alias("space"), F.col("key").alias("word"), "n")
        rare = heads.where(F.col("n") < HEADS).select(F.lit("prediction").alias("space"), F.col("key").alias("word"), "n", F.lit(False).alias("wide"))
        out.append(back.select(*row("head", "word")).unionByName(lookup(rare, back).select("space", F.col("read").alias("word")).distinct().select(*row("head", "word"))))
    return reduce(DataFrame.unionByName, out)


def head_keys(predictions: DataFrame, truth: bool) -> DataFrame:
    """``key, n``: lines at the edge of predictions that may be heads, and in how many samples each returns."""
    may = each_row(predictions.select("sample", "text", "truth"), "key string, sample string", lambda row: [(head_key(x.text), row["sample"]) for x in lines_in("prediction", row, truth) if "perhaps_head" in x.kinds])
    return may.groupBy("key").agg(F.countDistinct("sample").alias("n"))


# --- Spark ---------------------------------------------------------------------------------------

ROW = "field string, record_id string, block_id string, line_no int, noise string"
TEXT_ROW = "field string, record_id string, block_id string, text string"
_HELD: dict[str, dict[str, Answers]] = {}
Shared = tuple[str, Broadcast]


def held(shared: Shared, space: str) -> Answers:
    """The broadcast answers, sorted once per worker process."""
    name, rows = shared
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = {s: Answers.of(r[1:] for r in rows.value if r[0] == s) for s in ("scan", "prediction")}
    return _HELD[name][space]


def share(spark: SparkSession, answers: DataFrame, most: int) -> Shared | None:
    """All answers for every task, or nothing if they are more than ``most``."""
    found = answers.limit(most + 1).toArrow()
    if found.num_rows > most:
        return None
    return uuid.uuid4().hex, spark.sparkContext.broadcast(list(zip(*(c.to_pylist() for c in found.columns))) if found.num_rows else [])


def with_answers(df: DataFrame, kind: str, truth: bool, answers: DataFrame) -> DataFrame:
    """The records, each with the answers to its own questions: the way for answers that no task can hold."""
    df = df.withColumn("_row", F.xxhash64(*df.columns))
    def asks(row: dict) -> set[tuple[int, str]]:
        heads = [head_key(x.text) for x in lines_in(kind, row, truth) if "perhaps_head" in x.kinds] if kind == "prediction" else []
        return {(row["_row"], q) for q in (*(q for _, x in questions(kind, row, truth) for q in x), *(truth_words(row["truth"])[0] if kind == "prediction" and truth else ()), *heads)}

    ask = each_row(df, "_row long, asked string", asks).distinct()
    own = ask.join(answers.where(F.col("space") == space_of(kind)).drop("space"), "asked")
    own = own.groupBy("_row").agg(F.collect_list(F.struct("kind", "asked", "printed", "n", "places", "candidates")).alias("_answers"))
    return df.join(own, "_row", "left").drop("_row")


def _apply(df: DataFrame, kind: str, shared: Shared | None, repair: bool) -> DataFrame:
    """Rows of one field; the input columns are ``record_id`` and what the field's reader takes."""

    def work(row: dict) -> Iterable[tuple]:
        answers = held(shared, space_of(kind)) if shared else Answers.of(tuple(r.values()) for r in row["_answers"] or [])
        lines = unmarked(lines_in(kind, row, not repair, answers))
        if kind == "prediction" and not repair and row["truth"] is not None:
            mark_prediction(lines, row["truth"], answers)
        else:
            mark_words(lines, answers)
        if not repair:
            return [(kind, row["record_id"], x.block, x.no, noise) for x in lines for noise in x.kinds]
        blocks: dict[str, list[Line]] = {}
        for x in lines:
            blocks.setdefault(x.block, []).append(x)
        return [(kind, row["record_id"], b, reflow(ls)) for b, ls in blocks.items()]

    return each_row(df, TEXT_ROW if repair else ROW, work)


def frames(spark: SparkSession, folder: str, once: bool = False) -> dict[str, DataFrame]:
    """The three fields, with only the nested leaves that are used; ``once``: each delivery once."""
    from ..sources.tables import first_deliveries, nested_table

    run = nested_table(spark, folder, "payload", ["export_id", "parsing_run.id", "parsing_run.markdown_text", "parsing_run.page_count", "parsing_run.pages.blocks.content"])
    contents = F.transform(F.col("parsing_run.pages"), lambda p: F.when(p.isNotNull(), F.transform(p.blocks, lambda b: b.content)))
    vl = nested_table(spark, folder, "prescription_vl_result", ["result_id", "received_at", "pages.page_index", "pages.blocks.block_id", "pages.blocks.content"])
    ev = spark.read.parquet(f"{folder}/sample_evaluations.parquet").select("eval_id", "ingested_at", "sample_id", "prediction", "ground_truth")
    parts = {
        "payload_markdown": run.select(F.col("parsing_run.id").alias("record_id"), F.col("export_id").alias("_at"), F.col("parsing_run.markdown_text").alias("text"), F.col("parsing_run.page_count").alias("page_count"), contents.alias("pages")).where(F.col("text").isNotNull()),
        "vl_content": vl.select(F.col("result_id").alias("record_id"), F.col("received_at").alias("_at"), "pages"),
        "prediction": ev.select(F.col("eval_id").cast("string").alias("record_id"), F.col("ingested_at").alias("_at"), F.col("sample_id").alias("sample"), F.col("prediction").alias("text"), F.col("ground_truth").alias("truth")).where(F.col("text").isNotNull()),
    }
    return {k: (first_deliveries(df, "record_id", "_at") if once else df).drop("_at") for k, df in parts.items()}


def _noise(spark: SparkSession, folder: str, repair: bool, most: int) -> list[DataFrame]:
    from ..session import checkpoint_root, spread, wide_batches

    wide_batches(spark)
    checkpoint_root(spark)
    parts = frames(spark, folder, repair)
    if not repair:  # a prediction of one line that is its ground truth has no line end and no word that is not printed
        parts["prediction"] = parts["prediction"].where(~F.col("text").eqNullSafe(F.col("truth")) | F.col("text").contains("\n"))
    parts = {k: spread(df) for k, df in parts.items()}
    heads = head_keys(parts["prediction"].where(F.col("text").contains("\n")), not repair)
    asking = parts if repair else parts | {"truth": parts["prediction"].select(F.col("truth").alias("text")).where(F.col("text").isNotNull()).distinct()}
    answers = corpus_answers(counts(asking, not repair).checkpoint(), not repair, heads).checkpoint()
    shared = share(spark, answers, most)
    return [_apply(df if shared else with_answers(df, kind, not repair, answers), kind, shared, repair) for kind, df in parts.items()]


def found(spark: SparkSession, folder: str, most: int = ANSWERS) -> DataFrame:
    """One row per line and kind of noise."""
    return reduce(DataFrame.unionByName, _noise(spark, folder, False, most)).distinct()


def repaired(spark: SparkSession, folder: str, most: int = ANSWERS) -> DataFrame:
    """The three fields as continuous readable paragraphs."""
    return reduce(DataFrame.unionByName, _noise(spark, folder, True, most))


QUERIES = {"p4_found": found, "p4_repaired": repaired}
SQL: dict[str, str] = {}
