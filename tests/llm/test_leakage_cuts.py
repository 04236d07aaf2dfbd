import pytest

from vellumic.llm import leakage as L

ITEM = "Before anyone woke, the glazier returned a tin whistle with both hands. As the bells stopped, my aunt carried the spare key much too late, and old Brannoch forgot the lantern. Nobody asked where seven copper kettles went, nor why thirty geese slept below the mill that rainy evening."
WORDS = ITEM.split()
PAD = "Rain spoiled the plough before the soil could be cut.\n" * 5


KNOWN = L.Words(L.tokens(ITEM))


def ids(text):
    return [k for k, run, cover, _ in L.leaks(KNOWN, text, [(1, ITEM)]) if run >= L.RUN or cover >= L.COVER]


def copy(first, head, last):
    return PAD + " ".join(first) + "\n" + head + "\n" + " ".join(last) + "\n" + PAD


@pytest.mark.parametrize(
    "text,want",
    [
        (copy(WORDS[3:9], "81 folio 83", WORDS[9:15]), [1]),
        (copy(WORDS[3:5], "folio 12", WORDS[5:15]), [1]),
        (copy(WORDS[3:13], "folio 12", WORDS[13:15]), [1]),
        (copy(WORDS[3:9], "\nThe Harbour Book\n", WORDS[9:15]), [1]),
        (copy(WORDS[3:9], "xiv", WORDS[9:15]), [1]),
        (copy(WORDS[3:9], "A long running head that names the book\nand its second volume of the year\n\n17", WORDS[9:15]), [1]),
        (copy(WORDS[3:9], "81 folio 83", WORDS[9:14]), []),
        (copy(WORDS[3:9], "81 folio 83", WORDS[10:16]), []),
        (PAD + " ".join(WORDS[3:9]) + " and then we all went home " + " ".join(WORDS[9:15]) + "\n" + PAD, []),
    ],
)
def test_runs_cut_by_furniture(text, want):
    assert ids(text) == want


def test_word_cut_by_furniture():
    at = WORDS.index("whistle")
    text = copy([*WORDS[at - 5 : at], "whis-"], "The Harbour Book", ["tle", *WORDS[at + 1 : at + 7]])
    assert ids(text) == [1]
    assert ids(text.replace("whis-", "whis")) == []


def test_same_tokens():
    text = "One glazier's  word\n\n> two ﬁsh\x0cthree don’t\r\n- x"
    assert L.Page(text).raw == L.tokens(text)
