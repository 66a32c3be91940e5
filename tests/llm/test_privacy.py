import pytest

from mnesis.llm.privacy import find_personal, sanitise, scan_text, texts_of

GIVEN = frozenset("ingrid noemie samuel catherine daniel kwame".split())


@pytest.mark.parametrize(
    "text, kind, piece",
    [
        ("write to Ann.Lee+memo@post.example. Next", "email", "Ann.Lee+memo@post.example"), ("mail a-b [at] mail [dot] example [dot] net now", "email", "a-b [at] mail [dot] example [dot] net"), ("x (at) inbox.invalid !", "email", "x (at) inbox.invalid"),
        ("mon portable +33(0)199.00.71.94 (ne)", "phone", "+33(0)199.00.71.94"), ("call 0044207946 0519 after six", "phone", "0044207946 0519"), ("at 1.732.555.0186 now", "phone", "1.732.555.0186"), ("is (920) 555-0111 ok", "phone", "(920) 555-0111"),
        ("au 06-39-98-92-68.", "phone", "06-39-98-92-68"), ("+237 6 00 00 87 39 is", "phone", "+237 6 00 00 87 39"), ("ID card ZW1420963 was", "id_number", "ZW1420963"), ("number 948-85-1552 on", "id_number", "948-85-1552"), ("n° 2 83 04 99 851 991 71 scannée", "id_number", "2 83 04 99 851 991 71"),
        ("sofa to Flat 27, 212 Mill Lane, Belharra please", "address", "Flat 27, 212 Mill Lane, Belharra"), ("at 166B Old Quarry Road, Apt 18, Kirsanovo 99204 on", "address", "166B Old Quarry Road, Apt 18, Kirsanovo 99204"),
        ("au 168 bis impasse des Chardons, 99077 Santa Merola vendredi", "address", "168 bis impasse des Chardons, 99077 Santa Merola"), ("an Lindenweg 219a in 99660 Montefaro schicken", "address", "Lindenweg 219a in 99660 Montefaro"), ("a c/ Almendro, 100, 2.º B, Port-Elvin a fin", "address", "c/ Almendro, 100, 2.º B, Port-Elvin"),
        ("ask Ingrid Istgrogonwyn for", "person_name", "Ingrid Istgrogonwyn"), ("con FRUSKOBININ Kwame moved", "person_name", "FRUSKOBININ Kwame"), ("avec Fruceyalach, Catherine décalé", "person_name", "Fruceyalach, Catherine"), ("à noémie morgurekano pour", "person_name", "noémie morgurekano"),
        ("mit Daniel L. Karfogisez ist", "person_name", "Daniel L. Karfogisez"), ("Dr Samuel Holf sent", "person_name", "Samuel Holf"),
    ],
)
def test_forms(text, kind, piece):
    text = "😀 " + text
    got = [(text[s:e], k) for s, e, k, certain, *_ in scan_text(text, GIVEN) if certain]
    assert got == [(piece, kind)]


@pytest.mark.parametrize("text", ["parcel no. 00484129117 left", "order CMD-293473, invoice 2025-120742", "meter reads 134782.28", "Kargrodezot Health Clinic confirmed", "Waiting for Santa Merola", "version 4.12.2 at 13:04", "", "room 30, seat 857"])
def test_no_cases(text):
    assert not [p for p in scan_text(text, GIVEN) if p[3]]


def test_awkward_long_texts_take_linear_time():
    assert len(scan_text("ask Ingrid Suraname for +44 20 7946 0585 or a@b.test. " * 8000, GIVEN)) >= 24_000
    for text in ("a" * 200_000, "1" * 200_000, "1 " * 100_000, "Ab " * 60_000, "A. " * 60_000, "@" * 100_000, "a.b" * 60_000, "1, " * 60_000, "(" * 100_000):
        scan_text(text, GIVEN)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for i in range(60):
        rows += [f"ask Ingrid Sur{chr(97 + i % 20)}name for the keys", f"ID card ZW14209{i:02d} was scanned", f"parcel no. 0048412{i:04d} left the depot", "Waiting for Fernwick to open"]
    rows += ["ask J. Suraname for the keys", "ID card 958 722 605 was scanned", "parcel no. 958 722 605 left the depot", "see A. Fernwick to open", "parcel no. 948-85-1552 left the depot", "ask Weskinupin for the keys", None, "", "Ingrid Suraname " * 3000]
    m = spark.createDataFrame([(i, t, "k", 1, "x") for i, t in enumerate(rows)], "delivery_id bigint, content string, kind string, family int, tab string")
    a = spark.createDataFrame([("A1", "ask Ingrid Surbname for the keys", 1)] * 2 + [(None, "ask Ingrid Surbname", 1)], "artifact_id string, content string, term int")
    persons = spark.createDataFrame([(f"E{i}", f"Ingrid Name{i}", "PERSON") for i in range(4)] + [("N", None, None)], "entity_id string, canonical_name string, entity_type string")
    texts = texts_of(m, a)
    return rows, texts, find_personal(texts, persons)


def test_open_forms_follow_the_words_around(corpus):
    rows, _, found = corpus
    got = {(r.row_key, r.pii_type, r.start_pos, r.end_pos) for r in found.where("tab = 'messages'").collect()}
    key = {t: str(i) for i, t in enumerate(rows) if t}
    assert (key["ask J. Suraname for the keys"], "person_name", 4, 15) in got
    assert (key["ID card 958 722 605 was scanned"], "id_number", 8, 19) in got
    # among the words of parcel numbers a sure form is none; a name of no known form is one among those of names
    assert not [g for g in got if g[0] == key["parcel no. 948-85-1552 left the depot"]]
    assert not [g for g in got if g[0] in (key["parcel no. 958 722 605 left the depot"], key["see A. Fernwick to open"], key["Waiting for Fernwick to open"])]
    assert sum(g[0] == str(len(rows) - 1) for g in got) == 3000


def test_artifacts_once_and_sanitised_round_trip(corpus):
    rows, texts, found = corpus
    assert found.where("tab = 'artifacts'").count() == 1
    clean = {r.row_key: r.content for r in sanitise(texts, found).where("tab = 'messages'").collect()}
    assert clean["0"] == "ask <PERSON_NAME> for the keys" and clean["1"] == "ID card <ID_NUMBER> was scanned" and len(clean) == len(rows)
    blank = len(rows) - 3
    assert clean[str(blank)] is None and clean[str(blank + 1)] == ""


def test_empty(spark):
    m = spark.createDataFrame([], "delivery_id bigint, content string")
    a = spark.createDataFrame([], "artifact_id string, content string")
    p = spark.createDataFrame([], "canonical_name string, entity_type string")
    assert find_personal(texts_of(m, a), p).count() == 0
