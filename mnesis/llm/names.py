"""Variant spellings of names linked to the entity they mean (problem 3)."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnesis.operators.components import connected_components
from mnesis.shared import materialise, parallelism

#: Least share of q-grams that two tokens must have in common to be compared letter by letter.
TOKEN_SIMILARITY = 0.33
LEAST_SCORE = 0.72
#: Letters of the longest acronym looked up; organisations of more words have none.
MOST_INITIALS = 12
#: A short form is learned from this many family names at least, and from this share of those it stands with.
LEAST_FAMILIES, LEAST_SHARE = 2, 0.5
#: Similarity of a word and an abbreviation of it; no number of slips gives the same value.
ABBREVIATION = 0.845
_ACRONYM = "="  # before tokens that are derived initials: only the very same letters are like them
_SCALE = 1000.0  # of the token weights ln(1 + scale / frequency)

# Titles and legal forms that are no part of a name.
TITLES = frozenset(
    "dr prof mr mrs ms mme mlle monsieur madame herr frau sr sra srta don dona senor senora docteur doctor doctora dott sig signor signora mevrouw meneer miss sir the of de la le ltd inc llc gmbh".split()
)

def name_tokens(text: str | None) -> list[str]:
    """Words of a name: no case, accents, titles or legal forms; glued words split, dotted initials joined."""
    if not text or "://" in text or text.lstrip().startswith("@"):
        return []
    s = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])", " ", text)
    s = unicodedata.normalize("NFKD", s.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").lower())
    s = "".join(c for c in s if not unicodedata.combining(c))
    s = re.sub(r"\b(?:[a-z]\.){2,}", lambda m: m.group().replace(".", "") + " ", s)
    return [t for t in re.findall(r"[a-z0-9]+|[^\W\d_a-z]+", s.replace("'", "")) if t not in TITLES]


def org_variants(tokens: list[str]) -> list[list[str]]:
    """Acronyms of a name of several words: of the whole, and of what follows the first word."""
    if len(tokens) < 2:
        return []
    initials = "".join(t[0] for t in tokens)[:MOST_INITIALS]
    return [[_ACRONYM + initials], *([[tokens[0], _ACRONYM + initials[1:]]] if len(tokens) >= 3 else [])]


def slips(a: str, b: str, most: int = 3) -> int:
    """Edit distance in which swapped neighbours count once; ``most`` + 1 when beyond."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return row[-1]


def token_similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.8 if a[0] == b[0] else 0.0
    shorter, longer = sorted((a, b), key=len)
    if len(shorter) >= 3:
        most, x, y = 1 if len(shorter) < 6 else 2 if len(shorter) < 9 else 3, set(a), set(b)
        if len(x - y) <= most and len(y - x) <= most:  # each letter that only one has takes a slip
            d = slips(a, b, most)
            if d <= most:
                return 1 - d / len(longer) * 0.9
    it = iter(longer)
    if shorter[0] == longer[0] and len(longer) - len(shorter) >= 2 and all(c in it for c in shorter):
        return ABBREVIATION  # letters left out, the first kept
    return 0.0


_similarity = lru_cache(maxsize=1 << 18)(token_similarity)


@dataclass(frozen=True)
class Token:
    text: str
    weight: float
    given: bool = False  # leads several names: it can't carry a name alone
    full: tuple[str, ...] = ()  # what the token is a learned short form of

    def like(self, other: Token) -> float:
        if other.text[0] == _ACRONYM:
            return float(other.text[1:] == self.text)
        return max(0.95 if other.text in self.full else 0.0, _similarity(self.text, other.text))


def soft_score(mention: list[Token], name: list[Token]) -> float:
    """Soft weighted token similarity of two names in 0..1; 0 when they contradict each other.

    Tokens are paired best first. What both leave unpaired contradicts (another given name);
    tokens that only the fuller form has cost a part of their weight; rare tokens weigh most. Names
    of the same tokens score 1. Any other pair needs a token in common that is no given name, however
    many names hold it; abbreviations don't count.
    """
    if sorted(t.text for t in mention) == sorted(t.text for t in name):
        return 1.0
    like = [[a.like(b) for b in name] for a in mention]
    if any(len(a.text) > 1 and not any(row) for a, row in zip(mention, like)) and any(len(b.text) > 1 and not any(column) for b, column in zip(name, zip(*like))):
        return 0.0  # both have a token without a partner
    pairs = sorted(((like[i][j] * (1 + 0.001 * (a.weight + b.weight)), i, j) for i, a in enumerate(mention) for j, b in enumerate(name)), reverse=True)
    left, right, got, common = set(range(len(mention))), set(range(len(name))), 0.0, False
    for s, i, j in pairs:
        if s <= 0:
            break
        if i in left and j in right:
            left.discard(i)
            right.discard(j)
            s = like[i][j]
            got += s * name[j].weight
            close = s >= 0.7 and s != ABBREVIATION
            if close and len(mention[i].text) > 1 and len(name[j].text) > 1 and not name[j].given:
                common = True
    full_left = [i for i in left if len(mention[i].text) > 1]
    full_right = [j for j in right if len(name[j].text) > 1]
    if not common or left and full_right or full_left and right:
        return 0.0
    spare = sum(mention[i].weight for i in full_left) * 0.6 + sum(name[j].weight for j in full_right) * 0.25
    matched = sum(t.weight for j, t in enumerate(name) if j not in right)
    return got / (matched + spare) if matched else 0.0


def _tokenised_names(entities: DataFrame) -> DataFrame:
    """``entity_id, holder, written, form``: every name of an entity as tokens with spaces between.

    The ``holder`` is the set of tokens of the canonical name, so entries repeated for one name are
    one holder. Names that are not ``written`` are acronyms derived from them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for entity, kind, canonical, aliases in zip(pdf["entity_id"], pdf["entity_type"], pdf["canonical_name"], pdf["aliases"]):
                spellings = [canonical, *(aliases if aliases is not None else ())]
                forms = dict.fromkeys(" ".join(t) for t in map(name_tokens, spellings) if t)
                if not forms:
                    continue
                holder = " ".join(sorted(next(iter(forms)).split(" ")))
                rows += [(entity, holder, True, f) for f in forms]
                if kind == "ORG":
                    derived = dict.fromkeys(" ".join(v) for f in forms for v in org_variants(f.split(" ")))
                    rows += [(entity, holder, False, f) for f in derived if f not in forms]
            yield pd.DataFrame(rows, columns=["entity_id", "holder", "written", "form"])

    return entities.mapInPandas(run, "entity_id string, holder string, written boolean, form string")


def _forms(spellings: DataFrame) -> DataFrame:
    """``surface, n, form`` of spellings that have a token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.assign(form=[" ".join(name_tokens(x)) for x in pdf["surface"]])
            yield out[out["form"] != ""]

    return spellings.mapInPandas(run, "surface string, n bigint, form string")


def similar_tokens(left: DataFrame, right: DataFrame, threshold: float = TOKEN_SIMILARITY) -> DataFrame:
    """Pairs ``l, r`` of different tokens whose 3-gram sets overlap by ``threshold`` and that are a few slips apart.

    Prefix filter: in one global order of grams, rarest first, two sets with that similarity share a
    gram among their first ``n - ceil(t n) + 1``; only these are joined. Lengths, the overlap of
    the whole sets and the edit distance are verified on what they bring together. Grams are
    made once, for both sides.
    """
    sides = left.select("token", F.lit(1).alias("side")).unionByName(right.select("token", F.lit(2).alias("side")))
    vocabulary = sides.groupBy("token").agg(F.max(F.col("side") == 1).alias("on_left"), F.max(F.col("side") == 2).alias("on_right"))
    padded = F.concat(F.lit("^^"), F.col("token"), F.lit("$"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("token") + 1), lambda i: F.substring(padded, i, F.lit(3))))
    tokens = materialise(vocabulary.withColumn("grams", grams), "grams")
    exploded = tokens.select("token", F.explode("grams").alias("gram"))
    ranked = (
        exploded.join(exploded.groupBy("gram").agg(F.count(F.lit(1)).alias("f")), "gram")
        .groupBy("token").agg(F.array_sort(F.collect_list(F.struct("f", "gram"))).alias("g"))
    )
    keep = (F.size("g") - F.ceil(F.size("g") * threshold - 1e-9) + 1).cast("int")
    prefixes = ranked.select("token", F.explode(F.slice("g", F.lit(1), keep)).alias("s")).select("token", F.col("s.gram").alias("gram"))
    prefixes = materialise(prefixes.join(tokens, "token").repartition(parallelism(left.sparkSession), "token"), "gram-prefixes")
    l = prefixes.where("on_left").select("gram", F.col("token").alias("l"), F.col("grams").alias("gl"))
    r = prefixes.where("on_right").select("gram", F.col("token").alias("r"), F.col("grams").alias("gr"))
    shared = F.size(F.array_intersect("gl", "gr"))
    d, shorter = F.levenshtein("l", "r", 5), F.least(F.length("l"), F.length("r"))
    close = (d >= 0) & (d <= F.when(shorter < 5, 2).when(shorter < 8, 3).otherwise(5))
    near = l.join(r, "gram").where((F.col("l") != F.col("r")) & (F.abs(F.length("l") - F.length("r")) <= 3) & close)
    return near.where(shared >= threshold * (F.size("gl") + F.size("gr") - shared) - 1e-9).select("l", "r").distinct()


def learn_short_forms(forms: DataFrame, written: DataFrame, given: DataFrame) -> DataFrame:
    """``l, r``: tokens that stand in for a given name with which they share too few letters.

    Evidence is a spelling of two words ``x family`` where the list has ``r family`` but no ``x family``:
    ``x`` is a short form of ``r`` when it meets at least ``LEAST_FAMILIES`` families of bearers of ``r``
    and these are ``LEAST_SHARE`` of the listed families it is seen with. Spellings close to a bearer's
    own name are slips and no evidence.
    """
    two = lambda df: df.where(F.size(F.split("form", " ")) == 2).select(F.split("form", " ").alias("t"))
    both = lambda df: two(df).select(F.explode(F.array(F.struct(F.col("t")[0].alias("x"), F.col("t")[1].alias("family")), F.struct(F.col("t")[1].alias("x"), F.col("t")[0].alias("family")))).alias("p")).select("p.*").distinct()
    bearers = both(written).join(given.select(F.col("token").alias("x")), "x", "left_semi").withColumnRenamed("x", "r")
    seen = both(forms).where(F.length("x") >= 2).join(bearers.select("family", F.col("r").alias("x")), ["family", "x"], "left_anti")
    met = seen.join(bearers, "family")
    shorter = F.least(F.length("x"), F.length("r"))
    close = F.levenshtein("x", "r") <= F.when(shorter < 6, 1).when(shorter < 9, 2).otherwise(3)
    slips_of = met.where(close).select("family", "x").distinct()
    met = materialise(met.join(slips_of, ["family", "x"], "left_anti"), "short-forms")
    alone = met.groupBy("x").agg(F.countDistinct("family").alias("all"))
    pairs = met.groupBy("x", "r").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_FAMILIES).join(alone, "x")
    return pairs.where(F.col("n") >= LEAST_SHARE * F.col("all")).select(F.col("x").alias("l"), "r")


def _index(names: DataFrame) -> DataFrame:
    """``key, holder``: every token of more than a letter in the names of the holder, and its whole written names.

    ``soft_score`` asks for a token in common, or for the same tokens; no key is left out, however many
    holders share it. Given names can't carry a name, but lead to one whose family name is badly misspelt.
    """
    words = names.select("holder", F.explode(F.split("form", " ")).alias("key")).where(F.length("key") > 1).select("key", "holder")
    whole = names.where("written").select(_sorted("form").alias("key"), "holder")
    return words.unionByName(whole).distinct()


def _sorted(form: str) -> "F.Column":
    return F.array_join(F.array_sort(F.split(form, " ")), " ")


def _judged(pairs: DataFrame) -> DataFrame:
    """``form, holder, score`` above the least score; ``pairs`` has the written tokens of both."""

    def read(written: str) -> list[Token]:  # "token:frequency:given:full,full ..."
        out = []
        for part in written.split(" "):
            text, df, given, full = part.split(":")
            weight = math.log(1 + _SCALE / int(df)) if len(text) > 1 else 0.5
            out.append(Token(text, weight, given == "1", tuple(full.split(",")) if full else ()))
        return out

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lru_cache(maxsize=1 << 14)(lambda names: [read(x) for x in names.split("|")])
        for pdf in batches:
            rows, form, own = [], None, []
            for key, holder, written, names in zip(pdf["form"], pdf["holder"], pdf["own"], pdf["names"]):
                if key != form:
                    form, own = key, read(written)
                best = max(soft_score(own, x) for x in known(names))
                if best >= LEAST_SCORE:
                    rows.append((key, holder, round(best, 6)))
            yield pd.DataFrame(rows, columns=["form", "holder", "score"])

    parts = parallelism(pairs.sparkSession)
    return pairs.select("form", "holder", "own", "names").repartition(parts, "form").sortWithinPartitions("form").mapInPandas(judge, "form string, holder string, score double")


def _written(df: DataFrame, by: list[str], name: str, short: DataFrame | None = None) -> DataFrame:
    """The tokens of each group in order, as ``token:frequency:given:short form of``. ``df``: ``by, at, token, df, given``."""
    full = F.lit("")
    if short is not None:
        df = df.join(short.groupBy(F.col("l").alias("token")).agg(F.array_join(F.array_sort(F.collect_set("r")), ",").alias("full")), "token", "left")
        full = F.coalesce("full", F.lit(""))
    one = F.concat_ws(":", "token", F.coalesce("df", F.lit(1)), F.coalesce("given", F.lit(False)).cast("int"), full)
    ordered = F.array_sort(F.collect_list(F.struct("at", one.alias("w"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["w"]), " ").alias(name))


def link_mentions(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """``mention_id, entity_id, score``: one row per mention of a person or organisation that ``entities`` holds.

    Distinct spellings of mentions and the names of ``entities`` themselves are judged in one pass
    against all entities that hold a similar token. Entries of ``entities`` that stand for the same
    one share the smallest id. A spelling that fits several entities equally (a surname that
    relatives share) goes to the one with the most unambiguous mentions, among equals to the best
    score; where these are equal too, nothing tells the entities apart and it goes to none. Null and
    blank spellings, links, handles and unknown names yield no row; types are not used.
    """
    listed = entities.where("entity_id is not null").select("entity_id", "entity_type", "canonical_name", "aliases")
    owned = materialise(_tokenised_names(listed), "entity-names")
    names = materialise(owned.groupBy("holder", "form").agg(F.max("written").alias("written")), "holder-names")
    words = names.select("holder", "form", F.posexplode(F.split("form", " ")).alias("at", "token"), F.size(F.split("form", " ")).alias("n"))
    leads = F.countDistinct(F.when((F.col("at") == 0) & (F.col("n") > 1), F.col("holder")))
    frequency = words.groupBy("token").agg(F.countDistinct("holder").alias("df"), leads.alias("leads"))
    given = (F.col("df") >= 3) & (F.col("leads") >= 0.5 * F.col("df")) & (F.length("token") > 1)
    frequency = materialise(frequency.select("token", "df", given.alias("given")), "token-frequency")

    spelled = mentions.where("surface_form is not null").groupBy(F.col("surface_form").alias("surface")).agg(F.count(F.lit(1)).alias("n"))
    spelled = materialise(_forms(spelled), "spellings")
    forms = spelled.select("form", "n").unionByName(names.where("written").select("form", F.lit(0).cast("bigint").alias("n")))
    forms = materialise(forms.groupBy("form").agg(F.sum("n").alias("n")), "forms")
    short = materialise(learn_short_forms(forms, names.where("written"), frequency.where("given")), "learned-forms")

    tokens = forms.select("form", F.posexplode(F.split("form", " ")).alias("at", "token"))
    long = (F.length("token") >= 4) & ~F.startswith("token", F.lit(_ACRONYM))
    alike = similar_tokens(tokens.where(long).select("token").distinct(), frequency.where(long)).unionByName(short)
    keys = (
        alike.join(tokens.withColumnRenamed("token", "l"), "l").select("form", F.col("r").alias("key"))
        .unionByName(tokens.where(F.length("token") > 1).select("form", F.col("token").alias("key")))
        .unionByName(tokens.where(F.length("token").between(2, MOST_INITIALS)).select("form", F.concat(F.lit(_ACRONYM), "token").alias("key")))
        .unionByName(forms.select("form", _sorted("form").alias("key")))
    )
    candidates = keys.join(_index(names), "key").select("form", "holder").distinct()

    weighed = _written(tokens.join(frequency, "token", "left"), ["form"], "own", short)
    profile = _written(words.join(frequency, "token"), ["holder", "form"], "one").groupBy("holder").agg(F.array_join(F.array_sort(F.collect_list("one")), "|").alias("names"))
    scored = materialise(_judged(candidates.join(profile, "holder").join(weighed, "form")), "form-scores")

    # entries for the same entity: a written name of one fits the other. A name of several tokens links,
    # or a single one that fits no other entry.
    own = names.where("written").select(F.col("holder").alias("a"), "form")
    links = own.join(scored.withColumnRenamed("holder", "b"), "form").where("a <> b").withColumn("n_tokens", F.size(F.split("form", " ")))
    fits = links.groupBy("a", "n_tokens").agg(F.countDistinct("b").alias("fits"))
    links = links.join(fits, ["a", "n_tokens"]).where("(n_tokens > 1 and score >= 0.8) or fits = 1").select("a", "b").distinct()
    groups = connected_components(links)
    holders = owned.groupBy("holder").agg(F.min("entity_id").alias("entity_id")).join(groups.withColumnRenamed("node", "holder"), "holder", "left")
    smallest = Window.partitionBy(F.coalesce("component", "holder"))
    holders = materialise(holders.select("holder", F.min("entity_id").over(smallest).alias("group_id")), "entity-groups")

    fit = scored.join(holders, "holder").groupBy("form", "group_id").agg(F.max("score").alias("score"))
    rows = Window.partitionBy("form")
    top = fit.withColumn("best", F.max("score").over(rows)).where("score >= best - 0.03").withColumn("rivals", F.count(F.lit(1)).over(rows))
    top = materialise(top.join(forms.where("n > 0"), "form"), "form-fits")
    popular = top.where("rivals = 1").groupBy("group_id").agg(F.sum("n").alias("popularity"))
    weight = (F.coalesce("popularity", F.lit(0)).alias("p"), F.col("score").alias("s"))
    first = F.min_by(F.struct("group_id", "score"), F.struct(*(-w for w in weight), F.col("group_id")))
    last = F.max_by("group_id", F.struct(*weight, F.col("group_id")))
    best = top.join(popular, "group_id", "left").groupBy("form").agg(first.alias("b"), last.alias("last")).where("b.group_id = last")
    best = best.select("form", F.col("b.group_id").alias("entity_id"), F.col("b.score").alias("score"))
    found = spelled.join(best, "form").select(F.col("surface").alias("surface_form"), "entity_id", "score")
    return mentions.select("mention_id", "surface_form").join(found, "surface_form").select("mention_id", "entity_id", "score")
