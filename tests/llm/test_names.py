import pytest

from mnesis.llm.names import ABBREVIATION, link_mentions, name_tokens, similar_tokens, slips, token_similarity

ENTITIES = [
    ("E1", "Giuseppe Fruflimuxaud", "PERSON", None), ("E2", "G. Fruflimuxaud", "PERSON", ["Fruflimuxaud, Beppe"]), ("E3", "Sébastien Kestsogonez", "PERSON", ["Sebastien N. Kestsogonez"]), ("E4", "Gabrielle Kestsogonez", "PERSON", []),
    ("E5", "Tamluhamosk Relief Foundation", "ORG", ["Tamluhamosk RF"]), ("E6", "Lumvadezto Research Institute", "ORG", None), ("E7", None, None, None), ("E8", "Margaret Holcelenier", "PERSON", None), ("E9", "Margaret Weskinupin", "PERSON", None), ("E91", "Margaret Tamsolenoux", "PERSON", None),
]
FORMS = {
    "GiuseppeFruflimuxaud": "E1", "fruflimuxaud giuseppe": "E1", "Giusepe Fruflimxuaud": "E1", "G. Fruflimuxaud": "E1", "Margeret Holcelenier": "E8", "Holcelenier, M.": "E8", "Dr Holcelenier": "E8", "m.weskinupin": "E9",
    "the Tamluhamosk Relief Fdn": "E5", "Foundation Tamluhamosk Relief": "E5", "T.R.F.": "E5", "Lumvadezto": "E6", "Lumvadezto Res. Inst.": "E6", "LRI": "E6", "S. Kestsogonez": "E3", "Gab Kestsogonez": "E4",
    "Olga Kestsogonez": None, "Giuseppe Brufokorga": None, "budget": None, "Margaret": None, "@handle1": None, "https://example.org/1": None, "": None, None: None, "😂": None, "x" * 20_000: None,
}


@pytest.fixture(scope="module")
def linked(spark):
    rows = [(i, f, "PERSON", 1, "x") for i, f in enumerate(FORMS)] + [(900, "Margaret Holcelenier", None, 1, "x"), (900, "Margaret Holcelenier", None, 1, "x")]
    m = spark.createDataFrame(rows, "mention_id bigint, surface_form string, entity_type string, score int, entity_id string")
    e = spark.createDataFrame([(*x, 5, 0.5, 1) for x in ENTITIES], "entity_id string, canonical_name string, entity_type string, aliases array<string>, mention_count int, confidence double, key int")
    return [(r.mention_id, r.entity_id) for r in link_mentions(m, e).collect()]


@pytest.mark.parametrize("n, form", list(enumerate(FORMS)))
def test_spelling(linked, n, form):
    assert dict(linked).get(n) == FORMS[form], form


def test_repeated_mentions_keep_their_rows(linked):
    assert linked.count((900, "E8")) == 2


def test_names_of_common_tokens_only(spark):
    given = "Anna Bruno Clara Diego Elena Fabio Greta Hanno Irma Jonas".split()
    family = "Albrecht Bernardi Castellan Dominguez Engelhardt Fontaine Guerreiro Hoekstra Ivanenko Jankowski".split()
    full = [(f"P{i}{j}", f"{g} {f}") for i, g in enumerate(given) for j, f in enumerate(family)]
    e = spark.createDataFrame([(k, n, "PERSON", None) for k, n in full], "entity_id string, canonical_name string, entity_type string, aliases array<string>")
    forms = [n for _, n in full] + [f"{f}, {g}" for g, f in (n.split() for _, n in full)] + [n[:-3] + n[-2:] for _, n in full] + [given[0], family[0]]
    m = spark.createDataFrame(list(enumerate(forms)), "mention_id bigint, surface_form string")
    found = {r.mention_id: r.entity_id for r in link_mentions(m, e).collect()}
    assert found == {i: full[i % 100][0] for i in range(300)}


def test_a_token_of_many_names_drops_no_partner(spark):
    given = "Anna Bruno Clara Diego Elena Fabio Greta Hanno Irma Jonas Katja Lukas".split()
    people = [(f"P{i:02d}", f"{g} {m} Albrecht", "PERSON", None) for i, (g, m) in enumerate(zip(given, "Xenia Pavel Ottilie Quirin Runa Sveva Tibor Ulla Vito Wanda Yara Zdenko".split()))]
    people += [(f"R{i:02d}", f"{g} Bernardi", "PERSON", None) for i, g in enumerate(given)]
    firms = [(f"Q{i:02d}", f"{x} Research Institute", "ORG", None) for i, x in enumerate("Tamluhamosk Lumvadezto Kestsogonez Holcelenier Weskinupin Fruflimuxaud Brufokorga Drawefiloux Rasvalenard Kargrodezot".split())]
    e = spark.createDataFrame(people + firms, "entity_id string, canonical_name string, entity_type string, aliases array<string>")
    forms = [f"{g} Albrecht" for g in given] + ["Bernardi", "Olga Albrecht", "Dolphatunier RI", "Greta Bernardi"]
    m = spark.createDataFrame(list(enumerate(forms)), "mention_id bigint, surface_form string")
    found = {r.mention_id: r.entity_id for r in link_mentions(m, e).collect()}
    assert found == {**{i: f"P{i:02d}" for i in range(12)}, 12: "R06", 15: "R06"}


def test_short_forms_are_learned(spark):
    family = "Albrecht Bernardi Castellan".split()
    people = [(f"P{i}", f"Margaret {f}", "PERSON", None) for i, f in enumerate(family)] + [("P8", "Olga Castellan", "PERSON", None), ("P9", "Nadia Fontaine", "PERSON", None)]
    e = spark.createDataFrame(people, "entity_id string, canonical_name string, entity_type string, aliases array<string>")
    m = spark.createDataFrame([(1, "Peggy Albrecht"), (2, "Peggy Bernardi"), (3, "Castellan, Peggy"), (4, "Hugo Fontaine")], "mention_id bigint, surface_form string")
    assert {r.mention_id: r.entity_id for r in link_mentions(m, e).collect()} == {1: "P0", 2: "P1", 3: "P2"}


def test_empty(spark):
    m = spark.createDataFrame([], "mention_id bigint, surface_form string")
    e = spark.createDataFrame([], "entity_id string, canonical_name string, entity_type string, aliases array<string>")
    assert link_mentions(m, e).count() == 0


def test_tokens():
    assert name_tokens("Mr. d'Élan-MacRoy, J.R.") == ["delan", "mac", "roy", "jr"]
    assert slips("abcd", "abdc") == 1 and slips("abc", "xyz", 2) == 3
    assert token_similarity("fdn", "foundation") == ABBREVIATION and token_similarity("lars", "olga") == 0


def test_prefix_filter_loses_no_pair(spark):
    from mnesis.llm.names import TOKEN_SIMILARITY

    words = ["kestsogonez", "kestsogonze", "ketsogonez", "weskinupin", "wesknupin", "holcelenier", "fruflimuxaud", "fruflimuxxaud", "abcd", "abce", "tamvicovaud"]
    df = spark.createDataFrame([(w,) for w in words], "token string")
    grams = lambda w: {f"^^{w}$"[i : i + 3] for i in range(len(w) + 1)}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
            row = now
        return row[-1]

    most = lambda a, b: 2 if min(len(a), len(b)) < 5 else 3 if min(len(a), len(b)) < 8 else 5
    want = {(a, b) for a in words for b in words if a != b and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= TOKEN_SIMILARITY and lev(a, b) <= most(a, b)}
    assert want <= {(r.l, r.r) for r in similar_tokens(df, df).collect()}
