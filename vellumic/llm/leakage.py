"""Held-out passages that lie, whole or in part, in a corpus (problem 6).

1. Seeds: runs of ``SEED`` tokens. Those of the items and those of the documents are joined on their hashes; a document and an
   item stay a pair if they share as many seeds as any leak must. Up to ``SEEDS`` seeds of items are held by every task and joined
   where the documents lie, in one pass without a shuffle; beyond that it is an equi-join of narrow rows that Spark plans by
   size, and documents are joined to their pairs by the hash of their text. Either way the cost grows with what is shared.
2. Greedy string tiling with running Karp-Rabin of the pairs that are left: the longest common runs of tokens that are not yet marked
   are marked, again and again, down to runs of ``SEED`` tokens. Runs are found by rolling hashes and checked token by token.
3. Verdict: a run of ``RUN`` consecutive words of the item (page furniture between lines does not end a run: it is followed
   over whole lines, whatever is in them), or tiles in the item's order, close together, over at least ``COVER`` of its words.
   Beside these stands the share of the item in tiles of ``BLOCK`` words and more in any order, for passages put in another order.

Tokens are compared in their look-alike form of problem 3, in small letters, joined over line ends, and with misread
characters (problem 4's automata over the words of all items) put right. The items' words are held by every task
while there are at most ``VOCABULARY`` different ones; beyond that the documents' words are looked up in shards of them, and each
document is joined with what its own words stand for. The results are the same.

Defined results: null and empty texts leak nothing, an item with fewer than ``RUN`` words is leaked by
cover alone (one of one or two words by standing there whole), an item without words never; repeated documents each have their rows, a
document is read whole whatever its length; longest run and cover are the largest over the whole document.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ocr_noise import BREAKS, Trie, lookup, plain

SEED = 3
EDITS = 2  # confusions within a word
RUN = 12
COVER = 0.6  # of its words in tiles; single words between tiles come on top, passages in the same style stay below
CLOSE = 1.6  # a copy's words lie within this many times the item's length
BLOCK = 6  # words of a tile that counts in any order
FURNITURE = 10  # tokens of page furniture, a number among them, that may stand between two tiles of a run
LINES, CUTS = 4, 3  # lines left out whole, of FURNITURE tokens each on average at most, where a run is cut, and how many cuts; one within a word counts twice
VOCABULARY = 500_000  # different words of items that every task may hold
SEEDS = 1_000_000  # and seeds of items, with the items' texts

_BASE, _MOD = 1_000_003, (1 << 61) - 1
_TOKEN = re.compile(r"[^\W_]+(?:['’`´][^\W_]+)*")
_CUT = re.compile(rf"[^\W\d_][{BREAKS}]\s*$")
_SPLIT = re.compile(rf"(?<=[^\W\d_])[{BREAKS}][^\S\n]*\n[^\S\n]*(?:[>|*][^\S\n]*)?(?=[^\W\d_])")
_APOSTROPHES = str.maketrans("", "", "'’`´")


def words_in(text: str) -> list[str]:
    return [t.translate(_APOSTROPHES) if "'" in t or not t.isalnum() else t for t in _TOKEN.findall(text)]


def tokens(text: str) -> list[str]:
    """Words in their comparable form; the parts of a word split over a line end are one word."""
    return words_in(_SPLIT.sub("", plain(text)).casefold())


def token_lists(text: str) -> list[list[str]]:
    """The tokens with split words joined and, where there are any, also with their parts left apart."""
    text = plain(text)
    joined, n = _SPLIT.subn("", text)
    return [words_in(joined.casefold()), *([words_in(text.casefold())] if n else [])]


class Page:
    """The tokens of a text by its lines, split words not joined: where each line with tokens begins and ends, and whether it ends within a word."""

    def __init__(self, text: str):
        self.raw: list[str] = []
        self.lines: list[tuple[int, int, bool]] = []
        self.at: list[int] = []
        for line in plain(text).casefold().split("\n"):
            found = words_in(line)
            if found:
                self.at += [len(self.lines)] * len(found)
                self.lines.append((len(self.raw), len(self.raw) + len(found), bool(_CUT.search(line))))
                self.raw += found

    def broken(self) -> Iterator[str]:
        """The words that lines end within, joined with the beginnings of the lines that ``walk`` may go on to."""
        for at, (_, end, cut) in enumerate(self.lines):
            if cut:
                for start, _, _ in self.lines[at + 1 : at + 1 + LINES]:
                    yield self.raw[end - 1] + self.raw[start]


class Words:
    """Known words; others are put right if they are misreadings of one."""

    def __init__(self, known: Iterable[str]):
        self.known = set(known)
        self.trie = Trie(dict.fromkeys(self.known, 1))
        self.fixed = lru_cache(500_000)(self._fixed)
        self.code = lru_cache(500_000)(self._code)

    def _fixed(self, token: str) -> str:
        if token in self.known or len(token) < 2:
            return token
        found = self.trie.candidates(token, EDITS)
        return min(found, key=lambda w: (found[w][0], w)) if found else token

    def _code(self, token: str) -> int | None:
        """The hash of a token once put right; none for words that no item has."""
        word = self.fixed(token)
        return word_hash(word) if word in self.known else None


class Told:
    """The same for the words of one document, of which it is told what they stand for (``told_words``)."""

    def __init__(self, told: list[dict]):
        self.words = {x["read"]: x["word"] for x in told}

    def fixed(self, token: str) -> str:
        return self.words.get(token, token)

    def code(self, token: str) -> int | None:
        word = self.words.get(token)
        return None if word is None else word_hash(word)


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode()) + 1


def seed_hashes(codes: list[int | None], size: int = SEED) -> Iterator[int]:
    """Hashes of the runs of ``size`` codes without a gap."""
    for i in range(len(codes) - size + 1):
        h = size
        for c in codes[i : i + size]:
            if c is None:
                break
            h = (h * _BASE + c) % _MOD
        else:
            yield h


def needed(words: int) -> int:
    """Seeds that any leak of an item with so many words shares with its document at least.

    A run of ``RUN`` words in n + 1 pieces has RUN - 2 (n + 1) seeds or more, and what ``tiled`` says holds without cuts.
    """
    return min(tiled(words), RUN - (SEED - 1) * (CUTS + 1)) if words >= RUN else tiled(words)


def tiled(words: int) -> int:
    """The same for leaks by tiles: those of n words have n - 2 seeds, so one for every three words of the cover; a whole run has ten."""
    return 1 if words < SEED else min(RUN - SEED + 1, math.ceil(COVER * words / SEED))


Seeds = dict[tuple[str, ...], list[int]]


def seeds_of(words: list[str], size: int = SEED) -> Seeds:
    """Where the runs of ``size`` words stand."""
    out: Seeds = {}
    for i, seed in enumerate(zip(*(words[k:] for k in range(size)))):
        out.setdefault(seed, []).append(i)
    return out


class Item:
    """The words of an item and where its seeds stand."""

    def __init__(self, text: str):
        self.words = tokens(text)
        self.size = min(SEED, len(self.words))
        self.where = seeds_of(self.words, self.size) if self.size else {}
        self.own = lru_cache(1)(lambda: Words(self.words))

    def places(self, seeds: Seeds) -> list[int]:
        """Where seeds of the item stand in a document, given its own."""
        return sorted(j for seed in self.where.keys() & seeds.keys() for j in seeds[seed])


item_of = lru_cache(20_000)(Item)


def tiles(item: list[str], doc: list[str], least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item place, document place, length), longest first."""
    ids: dict[str, int] = {}
    a = [ids.setdefault(t, len(ids) + 1) for t in item]
    b = [ids.setdefault(t, len(ids) + 1) for t in doc]
    free_a, free_b = [True] * len(a), [True] * len(b)
    out: list[tuple[int, int, int]] = []
    size = min(len(a), len(b))
    while size >= least:
        longest = 0
        for match in sorted(_runs(a, b, free_a, free_b, size), key=lambda m: (-m[2], m[0], m[1])):
            i, j, n = match
            longest = max(longest, n)
            if n >= size and all(free_a[i : i + n]) and all(free_b[j : j + n]):
                free_a[i : i + n] = [False] * n
                free_b[j : j + n] = [False] * n
                out.append(match)
        size = size // 2 if size > 2 * least else size - 1
    return out


def _runs(a: list[int], b: list[int], free_a: list[bool], free_b: list[bool], size: int) -> Iterator[tuple[int, int, int]]:
    """Maximal common runs of free tokens of at least ``size`` tokens, found by Karp-Rabin hashes."""
    power = pow(_BASE, size - 1, _MOD)

    def hashes(x: list[int], free: list[bool]) -> Iterator[tuple[int, int]]:
        run, h = 0, 0
        for i, t in enumerate(x):
            if not free[i]:
                run, h = 0, 0
                continue
            if run == size:
                h = (h - x[i - size] * power) % _MOD
                run -= 1
            h = (h * _BASE + t) % _MOD
            run += 1
            if run == size:
                yield i - size + 1, h

    places: dict[int, list[int]] = {}
    for i, h in hashes(a, free_a):
        places.setdefault(h, []).append(i)
    for j, h in hashes(b, free_b):
        for i in places.get(h, ()):
            if i and j and free_a[i - 1] and free_b[j - 1] and a[i - 1] == b[j - 1]:
                continue  # part of a run that began before
            n = 0
            while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                n += 1
            if n >= size:
                yield i, j, n


def longest_run(found: list[tuple[int, int, int]], doc: list[str]) -> int:
    """Words of the longest stretch of the item without a gap in it; page furniture may stand between."""
    best, ends = 0, {}
    furniture = lambda f, j: f == j or (0 < j - f <= FURNITURE and any(t.isdigit() for t in doc[f:j]))
    for i, j, n in sorted(found):
        total = n + max((t for (e, f), t in ends.items() if e == i and furniture(f, j)), default=0)
        ends[i + n, j + n] = max(total, ends.get((i + n, j + n), 0))
        best = max(best, total)
    return best


def walk(fixed: Callable[[str], str], item: list[str], doc: list[str], page: Page, i: int, j: int, step: int, cuts: int = CUTS) -> int:
    """Words of the item from place i on (back, for step -1) that stand from j on; whole lines may be left out at their edge."""

    def beyond(first: int, line: int) -> Iterator[int]:
        """The near ends of the lines that follow when some whole lines are left out."""
        for m in range(first, first + LINES):
            if not 0 <= line + step * m < len(page.lines):
                return
            k = page.lines[line + step * m][0] if step > 0 else page.lines[line + step * m][1] - 1
            if abs(k - j) > LINES * FURNITURE:
                return
            yield k

    n, best = 0, 0
    while 0 <= i < len(item) and 0 <= j < len(doc):
        start, end, cut = page.lines[page.at[j]]
        near, far = (start, end - 1) if step > 0 else (end - 1, start)
        if cuts and j == near:
            for k in beyond(1, page.at[j]):
                if doc[k] == item[i]:
                    best = max(best, n + walk(fixed, item, doc, page, i, k, step, cuts - 1))
        if doc[j] != item[i]:
            if cuts and j == far and (cut or step < 0):
                for k in beyond(1, page.at[j]):
                    if step < 0 and not page.lines[page.at[k]][2]:
                        continue
                    word = page.raw[j] + page.raw[k] if step > 0 else page.raw[k] + page.raw[j]
                    if fixed(word) == item[i]:  # a word split over neighbouring lines is no cut
                        far_off = abs(page.at[k] - page.at[j]) > 1  # a cut within a word counts twice
                        if not far_off or cuts > 1:
                            best = max(best, n + 1 + walk(fixed, item, doc, page, i + step, k + step, step, cuts - 2 * far_off))
            break
        i, j, n = i + step, j + step, n + 1
    return max(best, n)


def cut_run(fixed: Callable[[str], str], item: Item, doc: list[str], page: Page, places: list[int]) -> int:
    """Longest run of the item through any of its seeds, with whole lines of page furniture left out."""
    best, before = 0, set()
    for j in places:
        for i in item.where.get(tuple(doc[j : j + item.size]), ()):
            if (i - 1, j - 1) not in before:  # else it is in the run of the seed before it
                best = max(best, walk(fixed, item.words, doc, page, i, j, 1) + walk(fixed, item.words, doc, page, i - 1, j - 1, -1))
            before.add((i, j))
    return best


def cover(found: list[tuple[int, int, int]], words: int) -> float:
    """The largest share of the item that tiles in its order cover within a close stretch of the document."""
    reach = int(CLOSE * words) + FURNITURE
    ordered = sorted(found, key=lambda t: (t[1], t[0]))
    best = 0
    for s, (si, sj, sn) in enumerate(ordered):  # chains that begin with tile s
        chains = [(si + sn, sj + sn, sn)]
        for i, j, n in ordered[s + 1 :]:
            if j + n - sj > reach:
                continue
            fit = max((c[2] for c in chains if c[0] <= i and c[1] <= j), default=None)
            if fit is not None:
                chains.append((i + n, j + n, fit + n))
        best = max(best, max(c[2] for c in chains))
    return best / words if words else 0.0


def clusters(places: list[int], words: int) -> list[tuple[int, int, int]]:
    """Stretches of the document around seeds that may belong to one copy: first and last seed, number of seeds."""
    reach = int(CLOSE * words) + FURNITURE
    out: list[list[int]] = []
    for p in places:
        if out and p - out[-1][1] <= reach:
            out[-1][1] = p
            out[-1][2] += 1
        else:
            out.append([p, p, 1])
    return [(a, b, n) for a, b, n in out]


def judge(item: Item, doc: list[str], places: list[int]) -> tuple[int, float, float]:
    """Longest run, cover in order and cover in any order, each the largest over all stretches that hold enough seeds."""
    run, share, loose = 0, 0.0, 0.0
    n = len(item.words)
    for a, b, seeds in clusters(places, n):
        if seeds < tiled(n):
            continue
        part = doc[a : b + item.size]
        found = tiles(item.words, part, item.size)
        run, share = max(run, longest_run(found, part)), max(share, cover(found, n))
        loose = max(loose, sum(t[2] for t in found if t[2] >= BLOCK) / n)
    return run, share, loose


def leaks(words: Words | Told | None, text: str | None, items: Iterable[tuple[int, str]], lists: list[list[str]] | None = None) -> list[tuple[int, int, float, float]]:
    """(item, longest run, cover, cover in any order) for each of the items that a text leaks. ``lists``: its tokens, if they are there."""
    if not text:
        return []
    lists = lists or token_lists(text)
    prepared: dict[tuple[int, int], list[tuple[list[str], Seeds]]] = {}
    page = None
    out = []
    for key, item_text in items:
        item = item_of(item_text or "")
        n = len(item.words)
        if not n:
            continue
        own = words or item.own()
        at = id(own), item.size
        if at not in prepared:
            fixed = [[own.fixed(t) for t in x] for x in lists]
            prepared[at] = [(x, seeds_of(x, item.size)) for x in fixed]
        (joined, seeds), (apart, seeds_apart) = prepared[at][0], prepared[at][-1]
        places = item.places(seeds)
        run, share, loose = judge(item, joined, places)
        if n >= RUN:
            if apart is not joined:
                places = item.places(seeds_apart)
            if len(places) >= needed(n) and any(c[2] >= needed(n) for c in clusters(places, n)):
                page = page or Page(text)
                run = max(run, cut_run(own.fixed, item, apart, page, places))
        if (run >= RUN and n >= RUN) or share >= COVER or loose >= COVER:
            out.append((key, run, share, loose))
    return out


# --- Spark ---------------------------------------------------------------------------------------

_HELD: dict[str, Words] = {}


def held(shared: tuple[str, Broadcast] | None, row: dict) -> Words | Told:
    """The words that every task holds, else those of the document."""
    if shared is None:
        return Told(row["told"])
    name, known = shared
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Words(known.value)
    return _HELD[name]


def item_words(items: DataFrame) -> DataFrame:
    """``word``: the different words of all items."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list({w for t in batch.column(0).to_pylist() for w in tokens(t)}), pa.string())], names=["word"])

    return items.select("item_text").mapInArrow(run, "word string").distinct()


def shared_words(items: DataFrame, most: int = VOCABULARY) -> tuple[str, Broadcast] | None:
    """The items' words for every task, or nothing if there are more than ``most``."""
    found = item_words(items).limit(most + 1).toArrow().column(0)
    return None if len(found) > most else (uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast(found.to_pylist()))


def told_words(keyed: DataFrame, items: DataFrame) -> DataFrame:
    """``text_key, told``: the words of each document that are words of items or misreadings of them, with what they stand for.

    The same words as by ``Words``: known ones stand, of several candidates the nearest and first is taken. Each different word is
    looked up once, in the shard of the items' words that shares its outline.
    """
    from ..session import checkpoint_root

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reads = [list({*(t for x in token_lists(text) for t in x), *Page(text).broken()}) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reads, pa.list_(pa.string()))], names=["text_key", "reads"])

    known = item_words(items)
    asked = keyed.select("text_key", "text").mapInArrow(run, "text_key long, reads array<string>").select("text_key", F.explode("reads").alias("read")).distinct()
    form = [F.lit("item").alias("space"), F.col("word"), F.lit(1).cast("long").alias("n")]
    unknown = asked.select(F.col("read").alias("word")).where(F.length("read") > 1).distinct().join(known, "word", "left_anti")
    near = lookup(unknown.select(*form, F.lit(False).alias("wide")), known.select(*form), EDITS)
    fixed = near.groupBy("read").agg(F.min(F.struct("cost", "word")).alias("b")).select("read", F.col("b.word").alias("word"))
    told = asked.join(known.select(F.col("word").alias("read"), "word").unionByName(fixed), "read")
    checkpoint_root(keyed.sparkSession)
    return told.groupBy("text_key").agg(F.collect_list(F.struct("read", "word")).alias("told")).checkpoint()  # seeds and verdicts read it


def item_seeds(items: DataFrame) -> DataFrame:
    """``seed, item_id, n, size, need``: the seeds of each item and how often it has them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = tokens(text)
                size = min(SEED, len(words))
                if size:
                    rows += [(h, key, size, needed(len(words))) for h in seed_hashes([word_hash(w) for w in words], size)]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["seed", "item_id", "size", "need"])

    rows = items.select("item_id", "item_text").mapInArrow(run, "seed long, item_id long, size int, need int")
    return rows.groupBy("seed", "item_id", "size", "need").agg(F.count(F.lit(1)).alias("n"))


def document_seeds(docs: DataFrame, shared: tuple[str, Broadcast] | None, sizes: list[int]) -> DataFrame:
    """``text_key, seed``: the different seeds of each document, without those that hold a word no item has. ``told`` is read if no words are shared."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                code = held(shared, row).code
                lists = [[code(t) for t in x] for x in token_lists(row["text"])]
                found.append(list({h for codes in lists for size in sizes for h in seed_hashes(codes, size)}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["text_key", "seeds"])

    return docs.select("text_key", *[c for c in docs.columns if c in ("text", "told")]).mapInArrow(run, "text_key long, seeds array<long>").select("text_key", F.explode("seeds").alias("seed"))


class Held:
    """Few items: their words, texts and seeds."""

    def __init__(self, known: list[str], items: list[tuple[int, str]], seeds: list[tuple[int, int, int, int, int]]):
        self.words = Words(known)
        self.texts = dict(items)
        self.sizes = sorted({x[2] for x in seeds})
        self.need = {x[1]: x[3] for x in seeds}
        self.seeds: dict[int, list[tuple[int, int]]] = {}
        for seed, item, _, _, n in seeds:
            self.seeds.setdefault(seed, []).append((item, n))

    def leaks(self, text: str) -> list[tuple[int, int, float, float]]:
        lists = token_lists(text)
        codes = [[self.words.code(t) for t in x] for x in lists]
        shared: dict[int, int] = {}
        for h in {h for x in codes for size in self.sizes for h in seed_hashes(x, size)}:
            for item, n in self.seeds.get(h, ()):
                shared[item] = shared.get(item, 0) + n
        pairs = [(k, self.texts[k]) for k, n in shared.items() if n >= self.need[k]]
        return leaks(self.words, text, pairs, lists) if pairs else []


_FEW: dict[str, Held] = {}
SCHEMA = "doc_id long, item_id long, run_words int, cover double, any_order double"


def scan(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, most_words: int = VOCABULARY, most_seeds: int = SEEDS) -> DataFrame:
    """``doc_id, item_id, run_words, cover, any_order`` for every document and item it leaks, in whatever order. Items' keys are unique."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.col("text") != ""))
    items = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("item_text")).where(F.col("item_text").isNotNull())
    shared = shared_words(items, most_words)
    own = item_seeds(items)
    seeds = own.select("seed", "item_id", "size", "need", "n").limit(most_seeds + 1).toArrow()
    few = shared is not None and seeds.num_rows <= most_seeds
    if few:
        known = [tuple(r.values()) for r in seeds.to_pylist()]
        texts = [tuple(r.values()) for r in items.join(own.select("item_id").distinct(), "item_id", "left_semi").toArrow().to_pylist()]  # no more than there are seeds
        held_items = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((shared[1].value, texts, known))
        both = source
    else:
        sizes = sorted(r[0] for r in own.select("size").distinct().collect())  # at most SEED values
        keyed = source.withColumn("text_key", F.xxhash64("text"))
        told = told_words(keyed, items) if shared is None else None
        with_told = lambda df: df if told is None else df.join(told, "text_key")
        met = document_seeds(with_told(keyed), shared, sizes).join(own, "seed").select("text_key", "item_id", "need", "seed", "n").distinct()  # a repeated text counts once
        hits = met.groupBy("text_key", "item_id", "need").agg(F.sum("n").alias("n")).where("n >= need")
        pairs = hits.select("text_key", "item_id").distinct().join(items, "item_id").groupBy("text_key").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))
        both = keyed.join(with_told(pairs), "text_key").drop("text_key")

    def found_in(row: dict) -> list[tuple[int, int, float, float]]:
        if not few:
            return leaks(held(shared, row), row["text"], [(i["item_id"], i["item_text"]) for i in row["items"]])
        name, parts = held_items
        if name not in _FEW:
            _FEW.clear()
            _FEW[name] = Held(*parts.value)
        return _FEW[name].leaks(row["text"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(row["doc_id"], *x) for row in batch.to_pylist() for x in found_in(row)]
            columns = list(zip(*rows)) if rows else [[] for _ in range(5)]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "run_words", "cover", "any_order"])

    return both.mapInArrow(run, SCHEMA)


#: A leak by definition: a run, or a cover in order.
IN_ORDER = f"run_words >= {RUN} OR cover >= {COVER}"


def report(spark: SparkSession, folder: str) -> DataFrame:
    from ..session import spread

    docs = spread(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return scan(docs, spark.read.parquet(f"{folder}/eval_items.parquet"), "doc_id", "text", "item_id", "text")


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the items they leak."""
    from ..session import wide_batches

    wide_batches(spark)
    return report(spark, folder).where(IN_ORDER).select("doc_id", "item_id").distinct()


def leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which test items leaked, into how many documents, in how many only in another order, and how much of them at most."""
    from ..session import wide_batches

    wide_batches(spark)
    each = report(spark, folder).groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("run_words", "cover", "any_order")])
    return each.groupBy("item_id").agg(
        F.count_if(F.expr(IN_ORDER)).alias("documents"), F.count_if(~F.expr(IN_ORDER)).alias("reordered_documents"), F.max("run_words").alias("longest_run"), F.round(F.max("cover"), 6).alias("most_cover"), F.round(F.max("any_order"), 6).alias("most_any_order")
    )


QUERIES = {"p6_found": found, "p6_leaked_items": leaked_items}
SQL: dict[str, str] = {}
