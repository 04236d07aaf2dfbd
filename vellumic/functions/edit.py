"""Edit scripts of words and characters: the one thing that Catalyst has no expression for. (It has one for distances.)

Among the scripts of least cost the one is taken that, read from the end, prefers match, substitution,
deletion, insertion in this order. Arrow batches in, Arrow batches out.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

OP = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("pos_a", T.IntegerType()), T.StructField("pos_b", T.IntegerType()), T.StructField("item_a", T.StringType()), T.StructField("item_b", T.StringType())]))


def script(a: Sequence[str], b: Sequence[str]) -> list[tuple[str, int, int, str | None, str | None]]:
    """Steps (op, place in a, place in b, item of a, item of b); an insertion stands before its place in a."""
    n, m = len(a), len(b)
    rows = [list(range(m + 1))]
    for i in range(1, n + 1):
        last, row = rows[-1], [i]
        for j in range(1, m + 1):
            row.append(min(last[j - 1] + (a[i - 1] != b[j - 1]), last[j] + 1, row[j - 1] + 1))
        rows.append(row)
    out, i, j = [], n, m
    while i or j:
        if i and j and a[i - 1] == b[j - 1] and rows[i][j] == rows[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append(("MATCH", i, j, a[i], b[j]))
        elif i and j and rows[i][j] == rows[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            out.append(("SUBSTITUTION", i, j, a[i], b[j]))
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
            out.append(("DELETION", i, j, a[i], None))
        else:
            j -= 1
            out.append(("INSERTION", i, j, None, b[j]))
    return out[::-1]


@pandas_udf(OP)
def word_script(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else [dict(zip(("op", "pos_a", "pos_b", "item_a", "item_b"), s)) for s in script(list(x), list(y))] for x, y in zip(a, b)])


@pandas_udf(OP)
def char_script(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else [dict(zip(("op", "pos_a", "pos_b", "item_a", "item_b"), s)) for s in script(x, y)] for x, y in zip(a, b)])


SCRIPTS = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("steps", OP)]))


def placed(a: Sequence[str], b: Sequence[str]) -> tuple[list[str | None], list[str]]:
    """What ``b`` has at each place of ``a`` (None: nothing), and what it has besides."""
    n, m = len(a), len(b)
    same = 0  # a script prefers matches from the end, so a common end is always matched
    while same < n and same < m and a[n - 1 - same] == b[m - 1 - same]:
        same += 1
    words: list[str | None] = [None] * (n - same) + list(a[n - same :])
    added = []
    for op, at, _, _, word in script(a[: n - same], b[: m - same]):
        if op == "INSERTION":
            added.append(word)
        else:
            words[at] = word
    return words, added


#: Signs that no normalized text holds: they count as blanks. Plain strings pass between the JVM and Python far faster than nested rows.
READING, ADDED, GAP = "\x1e", "\x1d", "\x1f"


@pandas_udf(T.StringType())
def _against_first(texts: pd.Series) -> pd.Series:
    def row(given: str) -> str:
        first, *others = given.split(READING)
        own = first.split()
        out = []
        for other in others:
            if other == first:
                out.append("")
                continue
            words, added = placed(own, other.split())
            out.append(f"{' '.join(GAP if w is None else w for w in words)}{ADDED}{' '.join(added)}")
        return READING.join(out)

    return texts.map(row, na_action="ignore")


def against_first(texts: Column) -> Column:
    """Normalized texts of a region: of every further one its words at the places of the first (null: none) and those it adds; null for one equal to the first."""
    parts = lambda text: F.filter(F.split(text, " "), lambda w: w != "")

    def read(told: Column) -> Column:
        both = F.split(told, ADDED)
        return F.when(told != "", F.struct(F.transform(parts(F.get(both, F.lit(0))), lambda w: F.nullif(w, F.lit(GAP))).alias("words"), parts(F.get(both, F.lit(1))).alias("added")))

    return F.transform(F.split(_against_first(F.array_join(texts, READING)), READING), read)


@pandas_udf(SCRIPTS)
def pairwise_scripts(texts: pd.Series) -> pd.Series:
    """Word scripts of all pairs of a region's texts, earlier against later."""
    keys = ("op", "pos_a", "pos_b", "item_a", "item_b")

    def row(given: Sequence[str]) -> list[dict]:
        words = [t.split() for t in given]
        return [{"a": i, "b": j, "steps": [dict(zip(keys, s)) for s in script(words[i], words[j])]} for i in range(len(words)) for j in range(i + 1, len(words))]

    return pd.Series([None if x is None else row(x) for x in texts], dtype=object)


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words, in the JVM: each different word of the pair is written as one character."""
    kinds = F.array_distinct(F.concat(a, b))

    def sign(word: Column) -> Column:
        place = F.array_position(kinds, word) + 0xFF
        code = F.when(place < 0xD800, place).otherwise(place + 0x800)  # no surrogates
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    written = lambda words: F.array_join(F.transform(words, sign), "")
    return F.when(a == b, 0).otherwise(F.levenshtein(written(a), written(b))).cast("long")
