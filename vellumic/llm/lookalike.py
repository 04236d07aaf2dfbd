"""One stored form for text that looks the same (problem 3).

Each Arrow batch is handed to an in-process DuckDB, whose SQL drops invisible characters, turns fixed
spaces into spaces, composes accents (``nfc_normalize``), and maps full-width forms and letters of
other scripts to the ASCII letter of the same shape (``translate``), half-width forms, ligatures and numerals of one sign to what
they are made of. What a reader can see stays: case, accents, superscripts, bold and other mathematical
letters, quotes and dashes, digits against letters, the number of spaces, line breaks.

Defined results: null stays null, an empty text stays empty, texts of any length are processed whole,
other columns are untouched (a clash with the new column's name is an error), an empty table stays empty.
No shuffle takes place.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.tables import first_deliveries

#: Letters of other scripts and the Latin letters of the same shape, in the order of their scripts.
SAME_SHAPE = [
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳανορυϲ", "ABEZHIKMNOPTYXCjavopuc"),  # Greek
    ("АВЕЅІЈКМНОРСТУХҮԌԚԜӀѴ", "ABESIJKMHOPCTYXYGQWIV"),  # Cyrillic capitals
    ("аеорсухѕіјһԁԛԝӏүѵ", "aeopcyxsijhdqwlyv"),  # Cyrillic small
    ("ՍՏՕսօհոցզյ", "USOuohngqj"),  # Armenian
    ("ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCEHJKLMPRSTVWZ"),  # Cherokee
    ("ⲞⲟⲤⲥⲢⲣ", "OoCcPp"),  # Coptic
]
#: Characters that show nothing, as the inside of a regular expression class.
INVISIBLE = r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}"
#: Spaces of a fixed width or kind, one for one.
SPACES = r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"


def shape_map(wide: bool = False) -> tuple[dict[str, str], dict[str, str]]:
    """Single characters to single characters, and the few that need more than one. ``wide``: with half-width forms, ligatures and numerals."""
    base = {a: b for own, latin in SAME_SHAPE for a, b in zip(own, latin, strict=True)}
    single, several = dict(base), {}
    for code in range(0x370, 0x530):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in base and unicodedata.normalize("NFC", parts) == chr(code):
            to = unicodedata.normalize("NFC", base[parts[0]] + parts[1:])
            (single if len(to) == 1 else several)[chr(code)] = to
    single |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
    for code in () if not wide else (*range(0xFF61, 0xFFEF), *range(0xFB00, 0xFB07), *range(0x2160, 0x2180)):  # half-width forms, ligatures, numerals of one letter or more
        to = unicodedata.normalize("NFKC", chr(code))
        if to != chr(code) and chr(code) not in "\uffa0" and unicodedata.category(chr(code)) != "Cn":
            (single if len(to) == 1 else several)[chr(code)] = to
    return single, several


def canonical_sql(text: str, wide: bool = False) -> str:
    """The DuckDB expression for the consistent form of an expression."""
    single, several = shape_map(wide)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"nfc_normalize(regexp_replace(regexp_replace({text}, '[{INVISIBLE}]', '', 'g'), '[{SPACES}]', ' ', 'g'))"
    out = f"translate({out}, {quote(''.join(single))}, {quote(''.join(single.values()))})"
    longer = out
    for a, b in several.items():
        longer = f"replace({longer}, {quote(a)}, {quote(b)})"
    return f"nfc_normalize(CASE WHEN regexp_matches({text}, '[{''.join(several)}]') THEN {longer} ELSE {out} END)"


def _plain(text: str, wide: bool = False) -> str:
    """Only texts with characters outside ASCII need the work."""
    return f"CASE WHEN strlen({text}) = length({text}) THEN {text} ELSE {canonical_sql(text, wide)} END"


def in_duckdb(df: DataFrame, sql: str, schema: T.StructType) -> DataFrame:
    """``sql`` over each Arrow batch, known to it as ``batch``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        target = to_arrow_schema(schema)
        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        for one in batches:
            con.register("batch", pa.Table.from_batches([one]))
            got = con.sql(sql).to_arrow_table().cast(target)
            con.unregister("batch")
            yield from got.to_batches()

    return df.mapInArrow(run, schema)


def canonical(df: DataFrame, columns: Sequence[str], suffix: str = "_canonical") -> DataFrame:
    """The table with a further column per text column."""
    clash = [c + suffix for c in columns if c + suffix in df.columns]
    if clash:
        raise ValueError(f"columns exist already: {clash}")
    schema = T.StructType([*df.schema.fields, *[T.StructField(c + suffix, T.StringType()) for c in columns]])
    name = lambda c: '"' + c.replace('"', '""') + '"'
    sql = "SELECT *, " + ", ".join(f"{_plain(name(c), True)} AS {name(c + suffix)}" for c in columns) + " FROM batch"
    return in_duckdb(df, sql, schema)


_SAME = f"{_plain('prediction')} = {_plain('ground_truth')}"


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluations whose two texts are stored differently and look the same; ligatures and the like are no such difference."""
    df = spark.read.parquet(f"{folder}/sample_evaluations.parquet").select("eval_id", "prediction", "ground_truth").where(F.col("prediction") != F.col("ground_truth"))
    schema = T.StructType([T.StructField("eval_id", T.LongType())])
    return in_duckdb(df, f"SELECT eval_id FROM batch WHERE {_SAME}", schema).distinct()


def normalized(spark: SparkSession, folder: str) -> DataFrame:
    """Both texts of every evaluation in their consistent form."""
    df = spark.read.parquet(f"{folder}/sample_evaluations.parquet").select("eval_id", "ingested_at", "prediction", "ground_truth")
    out = canonical(first_deliveries(df, "eval_id", "ingested_at").drop("ingested_at"), ["prediction", "ground_truth"])
    return out.select("eval_id", F.col("prediction_canonical").alias("prediction"), F.col("ground_truth_canonical").alias("ground_truth"))


def _by_character(text: str, wide: bool) -> str:
    """The same form another way, for comparison: character by character, by code points."""
    single, several = shape_map(wide)
    table = {a: b for a, b in (single | several).items() if not 0xFF01 <= ord(a) <= 0xFF5E}
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    ranges = lambda inside: " OR ".join(f"u BETWEEN {int(a, 16)} AND {int(b or a, 16)}" for a, b in re.findall(r"\\x\{([0-9A-F]+)\}(?:-\\x\{([0-9A-F]+)\})?", inside))
    each = (
        f"CASE WHEN {ranges(INVISIBLE)} THEN '' WHEN {ranges(SPACES)} THEN ' ' WHEN u BETWEEN 65281 AND 65374 THEN chr(u - 65248) "
        f"ELSE coalesce(list_extract([{', '.join(map(quote, table.values()))}], list_position([{', '.join(str(ord(a)) for a in table)}], u)), chr(u)) END"
    )
    points = lambda x: f"[unicode(substring({x}, i, 1)) FOR i IN range(1, length({x}) + 1)]"
    mapped = lambda x: f"nfc_normalize(array_to_string(list_transform({points(x)}, lambda u: {each}), ''))"
    plain = f"array_to_string(list_transform(list_filter({points(text)}, lambda u: NOT ({ranges(INVISIBLE)})), lambda u: chr(u)), '')"
    return f"CASE WHEN {text} = '' OR regexp_full_match({text}, '[\\x00-\\x7f]*') THEN {text} ELSE {mapped(f'nfc_normalize({plain})')} END"


_TEXTS = "SELECT DISTINCT eval_id, prediction, ground_truth FROM sample_evaluations"
_FORMS = f"f AS (SELECT t, {_by_character('t', False)} AS form, {_by_character('t', True)} AS wide FROM (SELECT DISTINCT unnest([prediction, ground_truth]) AS t FROM sample_evaluations))"
QUERIES = {"p3_found": found, "p3_normalized": normalized}
SQL = {
    "p3_found": f"WITH {_FORMS} SELECT DISTINCT eval_id FROM sample_evaluations e JOIN f p ON p.t = e.prediction JOIN f g ON g.t = e.ground_truth WHERE prediction <> ground_truth AND p.form = g.form",
    "p3_normalized": f"WITH {_FORMS} SELECT eval_id, p.wide AS prediction, g.wide AS ground_truth FROM ({_TEXTS}) e LEFT JOIN f p ON p.t = e.prediction LEFT JOIN f g ON g.t = e.ground_truth",
}
