import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumic.llm import ocr_noise as O

WORDS = "rain modern corner clear window carriage said left about 12 417 out patient report".split()


def brute(word, read, most, plain_edits=False):
    """Least cost to turn word into read and whether by confusions alone, by plain recursion."""
    best = [(99, True)]

    def go(i, j, n, odd):
        if n > most or (n, odd) >= best[0]:
            return
        if i == len(word) and j == len(read):
            best[0] = (n, odd)
            return
        if i < len(word) and j < len(read) and word[i] == read[j]:
            go(i + 1, j + 1, n, odd)
        for a, b in O.CONFUSIONS:
            if word.startswith(a, i) and read.startswith(b, j):
                go(i + len(a), j + len(b), n + 1, odd)
        if plain_edits:
            if i < len(word):
                go(i + 1, j, n + O.PLAIN, True)
            if j < len(read):
                go(i, j + 1, n + O.PLAIN, True)
            if i < len(word) and j < len(read):
                go(i + 1, j + 1, n + O.PLAIN, True)

    go(0, 0, 0, False)
    return best[0] if best[0][0] <= most else None


def spoil(word, rng, times):
    for _ in range(times):
        places = [(i, a, b) for a, b in O.CONFUSIONS for i in range(len(word)) if word.startswith(a, i)]
        if places:
            i, a, b = rng.choice(places)
            word = word[:i] + b + word[i + len(a) :]
    return word


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 3), st.booleans())
def test_automaton_finds_every_candidate(seed, times, plain_edits):
    rng = random.Random(seed)
    read = spoil(rng.choice(WORDS), rng, times)
    if plain_edits:
        at = rng.randrange(len(read) + 1)
        read = rng.choice([read[:at] + "x" + read[at:], read[:at] + read[at + 1 :], read[:at] + "k" + read[at + 1 :]])
    got = O.Trie(WORDS).candidates(read, plain_edits=plain_edits)
    want = {w: n for w in WORDS if w != read and (n := brute(w, read, O.MAX_EDITS, plain_edits)) is not None}
    assert {w: (n, places is None) for w, (n, places) in got.items()} == want


@settings(max_examples=200, deadline=None)
@given(st.text("abcdefghilmnoqrstuvwyz019", max_size=5), st.sampled_from(O.CONFUSIONS), st.text("abcdefghilmnoqrstuvwyz019", max_size=5))
def test_no_confusion_changes_an_outline(before, pair, after):
    assert O.outline(before + pair[0] + after) == O.outline(before + pair[1] + after)
    assert O.outlines(before + pair[0] + "k" + after) & O.outlines(before + pair[1] + after)  # nor does a plain edit beside it keep words apart


def test_lookup_equals_brute_force(spark):
    rng = random.Random(7)
    vocabulary = sorted({*WORDS, "o", "in", "no", "on", "noon", "moon", "nun", "minimum", "general", "ledger", "bill", "hill", "lantern"} - {"12", "417"})
    reads = sorted({spoil(rng.choice(vocabulary), rng, rng.randrange(4)) for _ in range(60)} | {"patieht", "patfent", "patien", "pattient", "gemeral", "xgeneral", "genral"})
    df = lambda rows, cols: spark.createDataFrame(rows, cols)
    got = O.lookup(df([("s", r, 1, True) for r in reads], "space string, word string, n long, wide boolean"), df([("s", w, 9) for w in vocabulary] + [("t", "patients", 9)], "space string, word string, n long")).collect()
    want = {(r, w): n for r in reads for w in vocabulary if w != r and (n := brute(w, r, O.MAX_EDITS, True)) is not None}
    assert {(x.read, x.word): (x.cost, x.places is None) for x in got} == want
    assert {r for r, w in want if w in ("patient", "general")} >= {"patieht", "patfent", "patien", "pattient", "gemeral", "genral"}


VOCABULARY = dict.fromkeys("the patient sleeps well and rain is said to come at noon prescription complaint as agreed report left ankle out no further harbour street clinic ward ledger".split(), 1000) | {"lane": 30}
COMPOUNDS = {"out-patient": 100}


def answers_to(lines):
    """What the corpus would say, word by word."""
    out, trie, joined = O.Answers(), O.Trie(VOCABULARY), O.Trie(COMPOUNDS)
    body, texts = O.body_of(lines)
    breaks = [c for i in range(len(body)) if (m := O.break_at_end(texts[i])) for c in O.continuations(body, texts, i, m)]
    for word in {m[0].casefold() for t in texts for m in O.WORD.finditer(t)} | {c[2] for c in breaks}:
        found = {w: x for w, x in trie.candidates(word).items() if VOCABULARY[w] >= O.RATIO * VOCABULARY.get(word, 0)}
        if found:
            best = min(found, key=lambda w: (found[w][0], w))
            out.fixes[word] = best, found[best][1]
    for _, _, join, compound in breaks:
        fixed = out.fixes.get(join, ("",))[0]
        out.whole[join] = VOCABULARY.get(join) or VOCABULARY.get(fixed, 0)
        out.hyphened[compound] = COMPOUNDS.get(compound) or max((COMPOUNDS[w] for w in joined.candidates(compound, 2)), default=0)
    return out


def marked(lines):
    O.mark_words(lines, answers_to(lines))
    return lines


def noise(lines):
    return sorted((x.block, x.no, k) for x in lines for k in x.kinds)


def test_words_of_a_record():
    text = "Regarding the prescrip-\n\nStreet Clinic Ward 3\n\n- 1 -\n\ntion as agreed. The out-\npatient sleeps wcll\n\nStrcet Clinic Ward 3\n\n- 2 -\n\nno fur¬\nthcr cornplaint, lane"
    pages = [["Regarding the prescrip-", "Street Clinic Ward 3", "- 1 -"], ["tion as agreed. The out-\npatient sleeps wcll", "Strcet Clinic Ward 3", "- 2 -"], ["no fur¬\nthcr cornplaint, lane"]]
    lines = marked(O.markdown_lines(text, pages, 3))
    assert noise(lines) == sorted([("", 0, "broken_word"), ("", 2, "running_head"), ("", 4, "page_number"), ("", 7, "misread"), ("", 9, "running_head"), ("", 11, "page_number"), ("", 13, "broken_word"), ("", 14, "misread")])
    assert O.reflow(lines) == "Regarding the prescription\n\nas agreed. The out-patient sleeps well\n\nno further complaint, lane"


def test_heads_need_two_pages_and_titles_stay():
    one = [(0, [("b0", "Sheet from the Clinic"), ("b1", "rain is said to come")]), (1, [("b2", "Findings"), ("b3", "rain\n106"), None, ("b4", None)]), None]
    assert noise(marked(O.block_lines(one))) == []
    two = [(1, [("b2", "WARD LEDGER   2"), ("b3", "noon"), ("b3", "noon")]), (0, [("b0", "Ward Lcdger   1"), ("b1", "rain"), ("b9", "[1]")])]
    assert noise(marked(O.block_lines(two))) == [("b0", 0, "running_head"), ("b2", 0, "running_head"), ("b9", 0, "page_number")]
    assert O.block_lines([]) == [] and O.block_lines(None) == []


@pytest.mark.parametrize(
    "prediction,truth,want",
    [
        ("The odd sernon", "The old sermon", []),
        ("The oId sermon", "The old sermon", [(0, "misread")]),
        ("The o1d serrnon", "The old sermon", [(0, "misread")]),
        ("the old sermon.", "The old sermon .", []),
        ("The sermon", "The old sermon", []),
        ("The old old sermon", "The old sermon", []),
        ("on 72 / 47", "on 12 / 47", [(0, "misread")]),
        ("on 12 / 47", "on 12 / 47", []),
        ("Page 3 of 8\nThe old sermon", "The old sermon", [(0, "page_number")]),
        ("Letter book Ostwick no. 3\nThe old sermon", "The old sermon", [(0, "running_head")]),
        ("The old ser­\nmon", "The old sermon", [(0, "broken_word")]),
        ("The old ser-\nrnon", "The old sermon", [(0, "broken_word"), (1, "misread")]),
        ("a long-\nterm plan", "a long-term plan", []),
        ("kettle ladder", "The old sermon", []),
        ("Сhe old", "Che old", []),
        ("тёмный лес", "тёмный лес", []),
        ("", "x", []),
        ("Page 3", "Page 3", []),
        ("- 4 -\nhello", None, [(0, "page_number")]),
    ],
)
def test_predictions(prediction, truth, want):
    words = {w.casefold() for w in O.WORD.findall(O.plain(truth or ""))} | {"lantern", "oak"}
    answers = O.Answers(heads={"letter book ostwick no"})
    lines = O.prediction_lines(prediction, truth, answers)
    body, texts = O.body_of(lines)
    breaks = [c for i in range(len(body)) if (m := O.break_at_end(texts[i])) for c in O.continuations(body, texts, i, m)]
    answers.candidates = {r: {w: p for w, (_, p) in O.Trie(words).candidates(r).items()} for r in {m[0].casefold() for t in texts for m in O.WORD.finditer(t)} | {c[2] for c in breaks}}
    answers.hyphened = {"long-term": 3}
    if truth is not None:
        O.mark_prediction(lines, truth, answers)
    assert sorted((x.no, k) for x in lines for k in x.kinds) == want


def test_a_break_is_looked_for_past_a_long_table():
    text = "the prescrip-\n\n" + "| rain | 3 |\n" * 40 + "\ntion as agreed"
    assert noise(marked(O.markdown_lines(text, None, 1))) == [("", 0, "broken_word")]


def test_page_numbers():
    for yes in ("[3]", "7", "p. 1/3", "Page 2 of 8", "PAGE 3", "Pagc 6 0f 8", "fol. 2", "- 3 -", "-- 4", "~ iv ~"):
        assert O.PAGE_NUMBER.match(yes), yes
    for no in ("Remarks", "Mirtavan", "12 mg", "page two of the letter", "10/10/2025", "Register 5", ""):
        assert not O.PAGE_NUMBER.match(no), no


def test_long_and_odd_texts():
    text = "\n".join(itertools.repeat("the patient sleeps wcll", 20_000))
    assert len(noise(marked(O.markdown_lines(text, None, None)))) == 20_000
    assert noise(marked(O.markdown_lines("\n\n\n", [], 0))) == []
    assert O.number_of("4l7") == ("417", (1,)) and O.number_of("417") is None and O.number_of("oil") is None


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("noise"))
    block = "struct<block_id:string,content:string>"
    run = ("r1", "the rain is said to come\n" * 400 + "thc rain", 1, [(0, [("b", "x")])])
    odd = ("r4", "harbour " * 60 + "harbiur harbur harbour7", 1, None)  # a character of no known shape, one lost, one that is a code
    rare = ("r3", "rain " * 1_000_000 + "zephyrine zephyrine zephyrine zcphyrine", 1, None)  # a word at three in a million
    spark.createDataFrame([(run, 1), (run, 2), (("r2", None, None, None), 3), (rare, 4), (odd, 5)], f"parsing_run struct<id:string,markdown_text:string,page_count:int,pages:array<struct<page_index:int,blocks:array<{block}>>>>, export_id long").write.parquet(f"{at}/payload.parquet")
    spark.createDataFrame([("v1", [(None, [("b1", "thc rain"), None]), None], 1), ("v2", None, 2)], f"result_id string, pages array<struct<page_index:int,blocks:array<{block}>>>, received_at int").write.parquet(f"{at}/prescription_vl_result.parquet")
    head = "Letter book Ostwick no. {}\n{}"
    rows = [(1, "s1", "o1d", "old"), (1, "s1", "o1d", "old"), (2, "s2", None, "a"), (3, "s3", "a", None), (4, "s4", "", ""), (5, "s5", head.format(2, "Quiet rain"), "Quiet rain"), (6, "s6", head.format(7, "Loud rain"), "Loud rain"), (7, "s7", head.format(8, "Odd rain").replace("Letter", "Lctter"), "Odd rain")]
    rows += [(n, f"t{n}", "old old old", "old old old") for n in range(50, 90)]
    spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "eval_id long, sample_id string, prediction string, ground_truth string, ingested_at int").write.parquet(f"{at}/sample_evaluations.parquet")
    return at


NOISE = [("payload_markdown", "r1", "", 400, "misread"), ("payload_markdown", "r3", "", 0, "misread"), ("payload_markdown", "r4", "", 0, "misread"), ("prediction", "1", "", 0, "misread"), *[("prediction", n, "", 0, "running_head") for n in "567"], ("vl_content", "v1", "b1", 0, "misread")]


@pytest.mark.parametrize("most", [O.ANSWERS, 0])
def test_found(spark, folder, most):
    """With the answers broadcast and joined alike."""
    assert sorted(map(tuple, O.found(spark, folder, most).collect())) == NOISE


@pytest.mark.parametrize("most", [O.ANSWERS, 0])
def test_repaired(spark, folder, most):
    rows = O.repaired(spark, folder, most).collect()
    fixed = {(r.field, r.record_id): r.text for r in rows}
    assert len(fixed) == len(rows)
    assert fixed["prediction", "1"] == "old" and fixed["vl_content", "v1"] == "the rain" and fixed["payload_markdown", "r1"].endswith("come the rain")
    assert fixed["payload_markdown", "r3"].endswith("zephyrine zephyrine zephyrine zephyrine") and fixed["payload_markdown", "r4"].endswith("harbour harbour harbour7") and fixed["prediction", "7"] == "Odd rain"
