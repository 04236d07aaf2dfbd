import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumic.llm import pii as P


def got(text):
    return [(s.kind, text[s.start : s.end]) for s in P.mentions(text)]


CASES = [
    ("Write to ann.bee@mail.test, please.", [("email", "ann.bee@mail.test")]),
    ("e-mail ann-bee7 (at) post (dot) example or ask", [("email", "ann-bee7 (at) post (dot) example")]),
    ("reach ann at post dot example.", [("email", "ann at post dot example")]),
    ("ann_b ＠\npost.example; only", [("email", "ann_b ＠\npost.example")]),
    ("Take 2 @ 8 a.m. and 1 @ 9 p.m. with water", []),
    ("Tel +1 (212) 555-0106 Dial the ward desk, extension 19, about it", [("phone", "+1 (212) 555-0106")]),
    ("Fax (01632) 960179\next. 2; at home", [("phone", "(01632) 960179\next. 2")]),
    ("Call 1-800-555-0123, after six", [("phone", "1-800-555-0123")]),
    ("Fax 212-555-O192, Drink", [("phone", "212-555-O192")]),
    ("Order 53940-29546 arrived on 03/01/2025.", []),
    ("Sample no. 86372 was compared with sample no. 58086.", []),
    ("Lab ID LAB50424, scale 1:381. Reference INV-2031-71551 covers", []),
    ("Passport no. DL00 77567756.", [("id_number", "DL00 77567756")]),
    ("Citizen number QQ 16 66 36 B.", [("id_number", "QQ 16 66 36 B")]),
    ("ID card no: 920-00-8740.", [("id_number", "920-00-8740")]),
    ("Social securlty no.\n959-00-6619.", [("id_number", "959-00-6619")]),
    ("National ID: 013698369818,", [("id_number", "013698369818")]),
    ("Lives at Flat 6, 176 2nd Main Road, Velmara. No further", [("address", "Flat 6, 176 2nd Main Road, Velmara")]),
    ("Resident at No. 41/7, Old Mint Road,\nStonnhaven - 000 041. Since", [("address", "No. 41/7, Old Mint Road,\nStonnhaven - 000 041")]),
    ("Address: Lindenhofweg 53,\n00053 Amselbruck; Kindly", [("address", "Lindenhofweg 53,\n00053 Amselbruck")]),
    ("Door 67, Bellfounder Way (near the well), North Deverill. Citizen", [("address", "Door 67, Bellfounder Way (near the well), North Deverill")]),
    ("102A HARROWBY AVENUE, OSTWICK. The", [("address", "102A HARROWBY AVENUE, OSTWICK")]),
    ("Room 13, Port Senn Fever Ward, opens. Street vendors near 4th Cross Lane sell no Catrosal.", []),
    ("According to Yorin Okrest, the cough was", [("name", "Yorin Okrest")]),
    ("According to Okrest, Yorin, the cough was", [("name", "Okrest, Yorin")]),
    ("The sheet was handed to YARROWBY ELSPA at the desk.", [("name", "YARROWBY ELSPA")]),
    ("Pt. Calla B. Tesmund/ Measurements", [("name", "Calla B. Tesmund")]),
    ("Next of kin: Mrs. E. Kalluri-\nOss. There", [("name", "E. Kalluri-\nOss")]),
    ("unchanged. J. O'Dremmel asked for the second reading.", [("name", "J. O'Dremmel")]),
    ("Notes of the Fever Ward: zelda korrigal   3\n\nrest", [("name", "zelda korrigal")]),
    ("Register 5 / Lantern Hill Dispensary\n\nrest", []),
    ("Doctor on duty: see\nboard at Ostwick Eye House.", []),
    ("", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_mentions(text, want):
    assert got(text) == want


def test_validators():
    assert P.luhn("4111 1111 1111 1111") and not P.luhn("4111 1111 1111 1112")
    assert P.mod97("GB82 WEST 1234 5698 7654 32") and not P.mod97("GB82 WEST 1234 5698 7654 33")
    assert P.verhoeff("2363") and not P.verhoeff("2364")
    iban = "Pay GB82 WEST 1234 5698 7654 32 now, insurance number: GB82 WEST 1234 5698 7654 32"
    assert ("id_number", "GB82 WEST 1234 5698 7654 32") in got(iban)


CARD, BAD_CARD = "4111 1111 1111 1111", "4111 1111 1111 1112"
IBAN, BAD_IBAN = "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"


@pytest.mark.parametrize(
    "text,want",
    [
        (f"Paid with {CARD} at noon.", [CARD]),  # confirmed: no label is needed
        (f"Passport number: {BAD_CARD}, he said.", []),  # refused: no label helps
        (f"IBAN {IBAN} as told.", [IBAN]),
        (f"Insurance number: {BAD_IBAN}.", []),
        ("National ID: 234567890124.", ["234567890124"]),
        ("seen as 234567890124 there", ["234567890124"]),
        ("National ID: 234567890123.", []),
        ("SSN 000-12-3456.", []),
    ],
)
def test_checks_decide(text, want):
    assert [text[s.start : s.end] for s in P.mentions(text) if s.kind == "id_number"] == want


def test_without_checks_the_outcome_is_another(monkeypatch):
    texts = [f"Paid with {CARD} at noon.", f"Passport number: {BAD_CARD}.", f"IBAN {IBAN}.", "SSN 000-12-3456."]
    before = [len(P.mentions(t)) for t in texts]
    monkeypatch.setattr(P, "CHECKED", dict.fromkeys(P.CHECKED, 0.0))
    assert before == [1, 0, 1, 0] and [len(P.mentions(t)) for t in texts] == [0, 1, 0, 1]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Later Miss Ada Brook rang.", ["Ada Brook"]),
        ("The nurse Ada Brook said it hurt.", ["Ada Brook"]),
        ("Only Ada Brook knew of it.", []),
        ("According to Yorin Okrest it rained. Then Yorin Okrest left.", ["Yorin Okrest", "Yorin Okrest"]),
        ("Signed at Harrow Street by the clerk.", []),
        ("Then Fever Ward said no.", []),
    ],
)
def test_names_by_shape_and_context(text, want):
    assert [text[s.start : s.end] for s in P.mentions(text) if s.kind == "name"] == want


@settings(max_examples=60, deadline=None)
@given(st.text("aB1 .@-(\n+", max_size=80))
def test_redaction_keeps_all_else(text):
    spans = P.mentions(text)
    assert all(a.end <= b.start for a, b in zip(spans, spans[1:]))
    out = P.redacted(text)
    for s in spans:
        out = out.replace(f"[{s.kind.upper()}]", text[s.start : s.end], 1)
    assert out == text


def test_long_text_and_spark(spark, tmp_path):
    long = "plain words and 12 numbers - " * 20_000 + "Tel 555.0120."
    assert got(long) == [("phone", "555.0120")]
    block = "struct<block_id:string,content:string>"
    spark.createDataFrame([(("r1", "Tel 555.0120."), 1), (("r1", "Tel 555.0120."), 2), (("r2", None), 3)], "parsing_run struct<id:string,markdown_text:string>, export_id long").write.parquet(str(tmp_path / "payload.parquet"))
    spark.createDataFrame([("v1", [([("b1", "Signed Ann Bee."), None, ("b1", "Signed Ann Bee.")],), None], 1), ("v1", [([("b1", "Signed Ann Bee."), None, ("b1", "Signed Ann Bee.")],), None], 2), ("v2", None, 3)], f"result_id string, pages array<struct<blocks:array<{block}>>>, received_at int").write.parquet(str(tmp_path / "prescription_vl_result.parquet"))
    assert sorted(map(tuple, P.found(spark, str(tmp_path)).collect())) == [("payload_markdown", "r1", "", 4, 12, "phone"), ("vl_content", "v1", "b1", 7, 14, "name")]
    assert sorted((r.record_id, r.text) for r in P.redact(spark, str(tmp_path)).collect()) == [("r1", "Tel [PHONE]."), ("v1", "Signed [NAME].")]
