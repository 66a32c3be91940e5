"""Personal information inside free text (problem 5)."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.shared import materialise

#: Bits by which a piece must disclose that it is personal: those of the words around it, of its own rare
#: word and of its form together.
LEAST_BITS = 1.0
#: Bits of a form. That of mail, street addresses, telephone and identity numbers and of a given name with a surname
#: is outweighed by words that stand with other numbers and names; any capitalised term may come out as a name,
#: but only by what its surroundings and its own word disclose.
SURE_FORM, OPEN_FORM, OTHER_FORM = 6.0, 0.0, -10.0
#: Persons of the protected list that must share a token for it to be a given name.
LEAST_BEARERS = 3
#: Given names are held in every task; a protected list with more of them is refused.
MOST_GIVEN_NAMES = 200_000

_CAP = r"[A-ZÀ-ÖØ-Þ]"
_TOWN = rf"(?:(?:Santa|San|Saint|Sainte|St\.?|Sankt|Port|Porto|Puerto|New|Los|Las|El|La|Le|Les|Bad|Den) )?{_CAP}[^\W\d_]+(?:[-'’]{_CAP}?[^\W\d_]+)*"
_NAME = rf"{_CAP}[^\W\d_]+(?:[-'’][^\W\d_]+)*"

_EMAIL = re.compile(
    r"(?<![\w.+-])[\w][\w.%+-]*\s?(?:@|＠|\[at\]|\(at\)|\{at\}|\s(?:at|AT)\s(?=\S+ ?(?:\[dot\]|\(dot\))))\s?[\w-]+(?:(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\}| dot )\s?)[\w-]+)*(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\})\s?)[^\W\d_]{2,}(?![\w])"
)
_PHONE = re.compile(
    r"(?<![\w+./-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){2,5}|00\d{2,10}(?:[ .-]\d{2,4}){1,4}|(?:1[ .-])?\(\d{3}\) ?\d{3}[ .-]\d{4}|1[.-]\d{3}[.-]\d{3}[.-]\d{4}"
    r"|0\d(?:[ .-]\d{2}){4}|0\d{3} \d{6}|0\d{2} \d{4} \d{4}|0\d{4} \d{6}|0[67]\d{8})(?![\w/]|[.-]\d)"
)
_ID = re.compile(
    r"(?<![\w+./-])(?P<sure>[A-Z]{2}\d{7}|[XYZ]\d{7}[A-Z]|\d{3}-\d{2}-\d{4}|[12] \d{2} (?:0[1-9]|1[0-2]|[2-9]\d) \d{2} \d{3} \d{3} \d{2})(?![\w/]|[.-]\d)"
    r"|(?<![\w+./-])(?<!\d )(?P<open>\d{3} \d{3} \d{3}|[12]\d{14}|\d{8}[A-Z])(?![\w/]|[.-]\d| \d)"
)
_ADDRESS = re.compile(
    # English: an optional flat, number and street, town, postcode
    rf"(?:(?:Flat|Apt|Unit) \d+[A-Za-z]?, )?\b\d{{1,4}}[A-Za-z]? (?:{_NAME} ){{1,3}}?(?:Street|Road|Lane|Avenue|Walk|Drive|Close|Court|Place|Square|Terrace|Way|Hill|Crescent|Row|Gardens)(?:, (?:Flat|Apt|Unit) \d+[A-Za-z]?)?, {_TOWN}(?:,? \d{{5}})?\b"
    # French: number, kind of street, name, postcode, town
    rf"|\b\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|chemin|bd|boulevard|avenue|av\.|impasse|allée|place|quai|cours|route|square|passage|sentier|ruelle) (?:(?:du|de|des|la|le|les|aux?) |de l['’]|d['’]|l['’])*{_NAME}(?: {_NAME})*,? (?:\d{{5}} )?{_TOWN}"
    # German: street, number, postcode, town
    rf"|\b(?:(?:Am|An der|Auf dem|Auf der|Im|In der|Zum|Zur|Unter den) )?{_NAME} \d{{1,4}} ?[a-z]?(?:,? in |, )\d{{5}} {_TOWN}"
    # Spanish, Italian, Portuguese: kind of street, name, number, door, postcode, town
    rf"|(?:\bc/|\b[Cc]alle|\b[Pp]laza|\b[Aa]venida|\b[Pp]aseo|\b[Cc]amino|\b[Rr]onda|\b[Vv]ia|\b[Vv]iale|\b[Pp]iazza|\b[Rr]ua) (?:(?:del|de|la|los|las|della|dei|do|da|dos|das) )*{_NAME}(?: {_NAME})*,? \d{{1,4}}[A-Za-z]?(?:, \d{{1,2}}\.?[ºª°] ?[A-Z])?, (?:\d{{5}} )?{_TOWN}"
    # Dutch: street, number, postcode, town
    rf"|\b{_CAP}[^\W\d_]+(?:straat|laan|weg|plein|gracht|kade) \d{{1,4}}[a-z]?, \d{{4}} ?[A-Z]{{2}} {_TOWN}"
)
_NUMBER = re.compile(r"(?<![\w+(])[\w+(]*\d[\d .,()/-]*\d[A-Z]?(?![\w])")
_DIGIT, _MAIL_SIGNS = re.compile(r"\d"), ("@", "＠", "at]", "at)", "at}", "dot")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
# Titles before a name.
_TITLES = frozenset("dr mme mlle m mr mrs ms prof frau herr doctora doctor senor senora sr sra docteur dra mevrouw meneer signora signor dott".split())


@lru_cache(maxsize=1 << 16)
def fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


class _Word:
    __slots__ = ("start", "end", "text", "low", "cap")

    def __init__(self, m: re.Match):
        self.start, self.end, self.text = m.start(), m.end(), m.group()
        self.low, self.cap = fold(self.text), self.text[0].isupper()


def scan_text(text: str, given: frozenset[str]) -> list[tuple]:
    """Pieces and slots of a text: ``(start, end, type, certain, term, left word, right word)``.

    Type ``number`` and ``slot`` stand for other numbers and other capitalised words: they are the
    background against which the words around pieces of certain form are weighed. A neighbour is
    None at an end of the text and beyond the end of a sentence.
    """
    out: list[tuple] = []
    taken = bytearray(len(text))
    words = [_Word(m) for m in _WORD.finditer(text)]
    starts, ends = [w.start for w in words], [w.end for w in words]

    def free(a: int, b: int) -> bool:
        return taken.find(1, a, b) < 0

    def around(a: int, b: int) -> tuple[str, str]:
        left, right = bisect_right(ends, a) - 1, bisect_left(starts, b)
        before = text[max(0, a - 12) : a].rstrip()
        cut = re.search(r"[.;\n]|//", text[max(0, a - 3) : a].rstrip()[-2:]) and not before.endswith(("no.", "nr.", "n°"))
        return (words[left].low if left >= 0 and not cut else None), (words[right].low if right < len(words) else None)

    def add(a: int, b: int, kind: str, certain: bool, term: str = "") -> None:
        taken[a:b] = b"\x01" * (b - a)
        out.append((a, b, kind, certain, term, *around(a, b)))

    if any(x in text for x in _MAIL_SIGNS):
        for m in _EMAIL.finditer(text):
            add(m.start(), m.end(), "email", True)
    if _DIGIT.search(text):  # every other form has a digit
        for m in _ADDRESS.finditer(text):
            if free(m.start(), m.end()):
                add(m.start(), m.end(), "address", True)
        for m in _ID.finditer(text):
            if free(m.start(), m.end()):
                add(m.start(), m.end(), "id_number", m.lastgroup == "sure")
        for m in _PHONE.finditer(text):
            if free(m.start(), m.end()):
                digits = sum(c.isdigit() for c in m.group())
                add(m.start(), m.end(), "phone", 9 <= digits <= 15)
        for m in _NUMBER.finditer(text):
            if free(m.start(), m.end()):
                add(m.start(), m.end(), "number", False)

    def gap(i: int, j: int) -> str:
        return text[words[i].end : words[j].start]

    used: set[int] = set()

    def name(i: int, j: int, surname: int, certain: bool) -> None:
        if free(words[i].start, words[j].end) and not any(k in used for k in range(i, j + 1)):
            used.update(range(i, j + 1))
            add(words[i].start, words[j].end, "person_name", certain, words[surname].low)

    n = len(words)
    for i, w in enumerate(words):
        if w.low not in given or i in used:
            continue
        nxt = i + 1 < n and gap(i, i + 1) in (" ", " ")
        if nxt and len(words[i + 1].text) == 1 and words[i + 1].cap and i + 2 < n and gap(i + 1, i + 2) in (". ", " ") and words[i + 2].cap:
            name(i, i + 2, i + 2, True)
        elif nxt and len(words[i + 1].text) > 2 and (words[i + 1].cap or not w.cap) and words[i + 1].low not in given:
            name(i, i + 1, i + 1, True)
        elif i and w.cap and gap(i - 1, i) == ", " and words[i - 1].cap and len(words[i - 1].text) > 2:
            name(i - 1, i, i - 1, True)
        elif i and gap(i - 1, i) == " " and words[i - 1].text.isupper() and len(words[i - 1].text) > 2:
            name(i - 1, i, i - 1, True)
    for i, w in enumerate(words):
        if i in used:
            continue
        if len(w.text) == 1 and w.cap and i + 1 < n and gap(i, i + 1) == ". " and words[i + 1].cap and len(words[i + 1].text) > 2 and i + 1 not in used:
            name(i, i + 1, i + 1, False)
        elif w.low in _TITLES and i + 1 < n and gap(i, i + 1) in (" ", ". ") and words[i + 1].cap and len(words[i + 1].text) > 2 and i + 1 not in used:
            if not (i + 2 < n and gap(i + 1, i + 2) == " " and words[i + 2].cap):
                name(i + 1, i + 1, i + 1, False)
    i = 0
    while i < n:  # runs of other capitalised words
        if words[i].cap and i not in used and len(words[i].text) > 1:
            j = i
            while j + 1 < n and words[j + 1].cap and gap(j, j + 1) == " " and j + 1 not in used:
                j += 1
            if free(words[i].start, words[j].end):
                out.append((words[i].start, words[j].end, "slot", False, words[i].low, *around(words[i].start, words[j].end)))
            i = j
        i += 1
    return out


def given_names(persons: DataFrame) -> frozenset[str]:
    """Tokens that several persons of the protected list share with different partners, and known short forms."""
    tokens = persons.where("canonical_name is not null and entity_type = 'PERSON'").select("canonical_name").distinct()
    plain = F.translate(F.lower("canonical_name"), "áàâäãéèêëíìîïóòôöõúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
    words = tokens.select(F.col("canonical_name"), F.explode(F.regexp_extract_all(plain, F.lit(r"(\p{L}{3,})"), F.lit(1))).alias("token"))
    words = words.withColumn("leads", F.expr("startswith(translate(lower(canonical_name), 'áàâäãéèêëíìîïóòôöõúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn'), token)").cast("int"))
    counts = words.groupBy("token").agg(F.countDistinct("canonical_name").alias("n"), F.avg("leads").alias("leads"))
    shared = counts.where((F.col("n") >= LEAST_BEARERS) & (F.col("leads") >= 0.5)).select("token")
    rows = shared.limit(MOST_GIVEN_NAMES + 1).collect()
    if len(rows) > MOST_GIVEN_NAMES:
        raise ValueError(f"more than {MOST_GIVEN_NAMES} given names")
    return frozenset({r.token for r in rows} - _TITLES)


_SCAN = "tab string, row_key string, start_pos bigint, end_pos bigint, kind string, certain boolean, term string, left_word string, right_word string"


def scan(texts: DataFrame, given: frozenset[str]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _SCAN.split(", ")]
        for pdf in batches:
            rows = [(tab, key, *piece) for tab, key, text in zip(pdf["tab"], pdf["row_key"], pdf["content"]) for piece in scan_text(text, shared.value)]
            yield pd.DataFrame(rows, columns=columns)

    return texts.where("content is not null and content <> ''").select("tab", "row_key", "content").mapInPandas(run, _SCAN)


def disclosure(pieces: DataFrame, column: str) -> DataFrame:
    """Bits by which a word gives away that a piece beside it (or holding it) is personal.

    ``word`` and a column of bits for each family: the log ratio of how often the word occurs with
    pieces of certain form of the family and how often with the family's background (other
    numbers, other names; for mail and street addresses both), each over its own total and
    smoothed by half a count. Pieces of open form count on neither side.
    """
    one = lambda c: F.sum(c.cast("bigint"))
    background = {"number": F.col("kind") == "number", "name": F.col("kind") == "slot"}
    either = F.col("kind").isin("number", "slot")
    counts = pieces.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("word")).agg(
        *[one(F.col("certain") & (F.col("family") == f)).alias(f"c_{f}") for f in FAMILIES], *[one(background.get(f, either)).alias(f"o_{f}") for f in FAMILIES]
    )
    counts = materialise(counts, "word-counts")
    totals = counts.agg(*[F.coalesce(F.sum(f"{x}_{f}"), F.lit(0)).alias(f"all_{x}_{f}") for f in FAMILIES for x in "co"])  # one row
    share = lambda x: (F.col(x) + 0.5) / (F.col(f"all_{x}") + 0.5)
    return counts.join(totals).select("word", *[F.log2(share(f"c_{f}") / share(f"o_{f}")).alias(f) for f in FAMILIES])


FAMILIES = ("number", "name", "email", "address")


def weigh(pieces: DataFrame) -> DataFrame:
    """Adds ``bits``: how strongly the words around a piece, its own rare word and its form disclose that it is personal."""
    bits = F.when(F.col("certain"), SURE_FORM).when(F.col("kind") == "slot", OTHER_FORM).otherwise(OPEN_FORM)
    weighed = pieces.where("kind <> 'number'")
    for column in ("left_word", "right_word", "term"):
        table = disclosure(pieces, column).withColumnsRenamed({f: f"_{f}" for f in FAMILIES}).withColumnRenamed("word", column)
        weighed = weighed.join(table, column, "left")
        own = F.coalesce(*[F.when(F.col("family") == f, F.col(f"_{f}")) for f in FAMILIES], F.lit(0.0))
        own = own if column != "term" else F.when(F.col("family") == "name", F.greatest(own, F.lit(0.0))).otherwise(0.0)
        weighed = weighed.withColumn(f"_bits_{column}", own).drop(*[f"_{f}" for f in FAMILIES])
        bits = bits + F.col(f"_bits_{column}")
    return weighed.withColumn("bits", bits).select(*pieces.columns, "bits")


def find_personal(texts: DataFrame, persons: DataFrame) -> DataFrame:
    """Personal pieces of ``texts`` (``tab, row_key, content``): ``tab, row_key, start_pos, end_pos, pii_type``.

    Candidates are all pieces of personal form and every other capitalised term. How strongly a word
    gives a protected piece away is measured over the whole corpus, by its co-occurrence with
    pieces of certain form (mail and street addresses, telephone and identity numbers, a given
    name of the protected list beside a surname) against all other numbers and names in the texts.
    Each candidate, those of certain form too, is weighed by the words around it, its own rare
    word and its form, and is personal when they exceed the threshold: a number of certain form
    among words that go with invoices is none. Positions count code points. Null and empty texts
    have no pieces; texts that repeat are each reported; every text is read in full.
    """
    pieces = scan(texts, given_names(persons))
    kind = F.col("kind")
    family = F.when(kind.isin("person_name", "slot"), "name").when(kind.isin("email", "address"), kind).otherwise("number")
    weighed = weigh(materialise(pieces.withColumn("family", family), "pieces"))
    found = weighed.where(F.col("bits") >= LEAST_BITS).withColumn("pii_type", F.when(kind == "slot", "person_name").otherwise(kind))
    return found.select("tab", "row_key", "start_pos", "end_pos", "pii_type")


def texts_of(messages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """All texts with their keys; an artifact exported twice counts once, every delivery counts."""
    m = messages.select(F.lit("messages").alias("tab"), F.col("delivery_id").cast("string").alias("row_key"), "content")
    a = artifacts.where("artifact_id is not null").groupBy("artifact_id").agg(F.min("content").alias("content"))
    return m.unionByName(a.select(F.lit("artifacts").alias("tab"), F.col("artifact_id").alias("row_key"), "content"))


def sanitise(texts: DataFrame, pieces: DataFrame) -> DataFrame:
    """``tab, row_key, content``: personal pieces replaced by ``<TYPE>``, the rest unchanged.

    Texts without pieces and null texts pass as they are. The pieces of one text meet in one row.
    """
    spans = pieces.groupBy("tab", "row_key").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "pii_type"))).alias("spans"))
    step = lambda acc, s: F.struct(
        F.concat(acc["done"], F.substr(F.col("content"), (acc["at"] + 1).cast("int"), F.greatest(s["start_pos"] - acc["at"], F.lit(0)).cast("int")), F.lit("<"), F.upper(s["pii_type"]), F.lit(">")).alias("done"),
        s["end_pos"].alias("at"),
    )
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))
    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["done"], F.substr(F.col("content"), (acc["at"] + 1).cast("int"))))
    return texts.join(spans, ["tab", "row_key"], "left").select("tab", "row_key", F.when(F.col("spans").isNull(), F.col("content")).otherwise(clean).alias("content"))
