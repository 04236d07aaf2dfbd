import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumic.llm import leakage as L
from vellumic.llm import ocr_noise as N

ITEM = "Before anyone woke, the glazier returned a tin whistle with both hands. As the bells stopped, my aunt carried the spare key much too late, and old Brannoch forgot the lantern."
PAD = "Rain spoiled the plough before the soil could be cut. " * 5


def brute_tiles(a, b, least):
    """Greedy string tiling by trying every pair of places."""
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best = []
        longest = least
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and fa[i + n] and fb[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > longest:
                    best, longest = [(i, j, n)], n
                elif n == longest:
                    best.append((i, j, n))
        if not best:
            return out
        for i, j, n in best:
            if all(fa[i : i + n]) and all(fb[j : j + n]):
                fa[i : i + n] = fb[j : j + n] = [False] * n
                out.append((i, j, n))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=16))
def test_tiling_covers_as_much_as_brute_force(a, b):
    got, want = L.tiles(a, b), brute_tiles(a, b, L.SEED)
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in got)
    assert len({i + x for i, _, n in got for x in range(n)}) == len({j + x for _, j, n in got for x in range(n)}) == sum(n for _, _, n in got)
    assert max((n for _, _, n in got), default=0) == max((n for _, _, n in want), default=0)
    assert bool(got) == bool(want)


ITEMS = [(1, ITEM), (2, "Nobody saw how a pedlar, quietly, weighed the empty birdcage below the weir one foggy Tuesday."), (3, None), (4, "")]
KNOWN = L.Words({w for _, t in ITEMS for w in L.tokens(t or "")})


def ids(text, items=ITEMS, known=KNOWN):
    return [k for k, run, cover, _ in L.leaks(known, text, items) if run >= L.RUN or cover >= L.COVER]


WORDS = ITEM.split()


@pytest.mark.parametrize(
    "text,want",
    [
        (PAD + ITEM + PAD, [1]),
        (PAD + ITEM.upper().replace(" ", " "), [1]),
        (PAD + " ".join(WORDS[3:15]) + " " + PAD, [1]),
        (PAD + " ".join(WORDS[3:14]) + " " + PAD, []),
        (PAD + "\n> ".join(" ".join(WORDS[i : i + 5]) for i in range(0, 30, 5)), [1]),
        (PAD + " ".join(WORDS[:8]) + "\n\n81 folio 83\n\n" + " ".join(WORDS[8:14]), [1]),
        (PAD + " ".join(w for i, w in enumerate(WORDS) if i % 6 != 5), [1]),
        (PAD + ITEM.replace("whistle", "vvhist1e").replace("glazier", "gla-\nzier").replace("carried", "carrled"), [1]),
        (PAD + "Before anyone woke, the sexton hid a jar of ink with both hands. As the bells stopped, a girl wept.", []),
        (PAD, []),
        ("", []),
        (None, []),
    ],
)
def test_cases(text, want):
    assert ids(text) == want
    assert ids(text, known=None) == want  # with each item's own words


def test_reordered_and_long():
    half = " ".join(WORDS[:13]), " ".join(WORDS[13:])
    assert ids(half[1] + " " + PAD + half[0]) == [1]
    assert ids(PAD * 2000 + ITEM + PAD * 2000) == [1]
    rng = random.Random(5)
    words = WORDS[:]
    rng.shuffle(words)
    assert ids(" ".join(words)) == []


@pytest.mark.parametrize("size", [8, 10])
def test_blocks_in_reverse_order(size):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    item = [(9, " ".join(words))]
    known = L.Words(words)
    text = PAD + " ".join(" ".join(words[i : i + size]) for i in range(40 - size, -1, -size)) + " " + PAD
    [(key, run, cover, loose)] = L.leaks(known, text, item)
    assert key == 9 and run == size and cover == size / 40 and loose == 1.0


def test_short_items():
    items = [(1, "alpha beta"), (2, "gamma"), (3, "one two three"), (4, "?")]
    assert ids("here alpha beta there", items, None) == [1] and ids("a gamma ray", items, None) == [2] and ids("zero one two three", items, None) == [3]
    assert ids("alpha and beta", items, None) == []


def test_the_longest_run_of_all_is_told():
    fragment = " ".join(WORDS[2:14])
    [(_, run, cover, _)] = L.leaks(KNOWN, fragment + " " + PAD * 9 + ITEM + " " + PAD, ITEMS[:1])
    assert run == len(WORDS) and cover == 1.0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([f"w{c}" for c in "abcdefgh"]), min_size=12, max_size=18), st.randoms())
def test_run_equals_brute_force(item, rng):
    doc = ["x"] * 3 + item[rng.randrange(6) :][: rng.randrange(4, 14)] + ["y"] * rng.randrange(3) + [rng.choice(item) for _ in range(8)]
    longest = max(n for i in range(len(item)) for j in range(len(doc)) for n in [next((k for k in range(len(item)) if i + k >= len(item) or j + k >= len(doc) or item[i + k] != doc[j + k]), len(item) - i)])
    known = L.Words(set(item) | {"x", "y"})
    got = L.leaks(known, " ".join(doc), [(1, " ".join(item))])
    if longest >= L.RUN:
        assert got[0][1] == longest
    elif got:
        assert got[0][1] <= max(longest, L.RUN - 1)


@settings(max_examples=150, deadline=None)
@given(st.integers(12, 40), st.randoms())
def test_a_run_never_has_fewer_seeds_than_needed(n, rng):
    """Of a run of twelve words in as many pieces as cuts allow."""
    cuts = sorted(rng.sample(range(1, L.RUN), rng.randint(0, L.CUTS)))
    pieces = [b - a for a, b in zip([0, *cuts], [*cuts, L.RUN])]
    assert sum(max(0, p - L.SEED + 1) for p in pieces) >= L.needed(n) or L.needed(n) > L.RUN - (L.SEED - 1) * (L.CUTS + 1)
    assert L.needed(n) <= L.RUN - (L.SEED - 1) * (L.CUTS + 1)


def test_spark(spark):
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, "x"), (4, PAD + ITEM)], "doc_id long, text string")
    held = spark.createDataFrame([(7, ITEM), (8, "short one")], "item_id long, text string")
    rows = [tuple(r)[:2] for r in L.scan(docs, held, "doc_id", "text", "item_id", "text").collect()]
    assert sorted(rows) == [(1, 7), (1, 7), (4, 7)]
    assert sorted(tuple(r)[:2] for r in L.scan(docs, held, "doc_id", "text", "item_id", "text", most_words=3).collect()) == [(1, 7), (1, 7), (4, 7)]
    assert sorted(tuple(r)[:2] for r in L.scan(docs, held, "doc_id", "text", "item_id", "text", most_seeds=2).collect()) == [(1, 7), (1, 7), (4, 7)]
    assert L.scan(docs, spark.createDataFrame([(1, None), (2, "...")], "item_id long, text string"), "doc_id", "text", "item_id", "text").count() == 0
    assert L.scan(docs, held.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    assert L.scan(docs.limit(0), held, "doc_id", "text", "item_id", "text").count() == 0


MISREAD = ITEM.replace("woke", "w0ke").replace("glazier", "g1azier").replace("whistle", "vvhist1e").replace("hands", "bands").replace("bells", "be11s").replace("carried", "carrled").replace("key", "kev").replace("late", "1ate").replace("old", "o1d").replace("lantern", "lantem")
CUT = " ".join(WORDS[:9]) + " tin vvhis-\nThe Harbour Book\nt1e " + " ".join(WORDS[10:20])


def test_results_are_the_same_however_many_words_the_items_have(spark):
    """Misread in every third word; a word of another item where one of its own stands; a word cut by a head; a text twice."""
    items = [(7, ITEM), (8, "Thirty brass bands marched over the river bridge singing loudly until every last lamp was out."), (9, "lantem"), (10, "tin"), (11, "x y")]
    docs = [(1, PAD + MISREAD + " " + PAD), (2, PAD + ITEM.replace("both hands", "both bands")), (3, PAD + CUT + "\n" + PAD), (4, PAD + CUT + "\n" + PAD), (5, MISREAD + " " + MISREAD), (6, None), (7, PAD), (8, "x v"), (9, "a lantem, a t1n")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")

    def rows(**most):
        return sorted(tuple(r) for r in L.scan(docs, items, "doc_id", "text", "item_id", "item_text", **most).collect())

    want = rows()
    found = {r[:2] for r in want}
    assert {(1, 7), (2, 7), (3, 7), (4, 7), (5, 7), (9, 9), (9, 10)} <= found and not any(d in (6, 7) for d, _ in found)
    assert rows(most_words=3) == want and rows(most_seeds=2) == want and rows(most_words=3, most_seeds=2) == want


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(sorted({*WORDS, "minimum", "quill", "clod"})), st.randoms())
def test_confusions_leave_the_outline(word, rng):
    """So a misread word and the word it stands for meet in one shard."""
    word = read = word.lower()
    for _ in range(L.EDITS):
        printed, as_read = rng.choice(N.CONFUSIONS)
        read = read.replace(printed, as_read, 1)
    assert N.outline(read) == N.outline(word)
