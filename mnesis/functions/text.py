"""Text predicates and extractors as built-in expressions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that alone make a message noise.
FILLERS = (
    "ok oui non okok hmm hm ah oh ohh mdr lol lool loool ptdr haha hahaha hihi yes no yeah yep nope nah wow aww awww yo hey sûr sure cool nice merci "
    "thanks thx svp pls please bon bah bof quoi hein euh genre wsh wallah jsp idk btw omg ikr stp dac dacc d'accord d'ac ouais mouais mmh mhm okk okkk okkkk"
).split()
# Lexicons of the mood count.
POSITIVE = (
    "love happy beautiful wonderful amazing great good best excellent pretty sweet nice enjoy amour aimer belle beau magnifique super génial bien meilleur "
    "bonheur heureux content merci bisous câlin doux tendresse joie 😍 ❤ 😘 🥰 😊 💕 🤗 💖 💗"
).split()
NEGATIVE = (
    "sad angry bad terrible horrible hate upset worry problem issue wrong sorry miss triste fâché colère problème mauvais peur inquiet désolé manque pleure "
    "mal douleur pénible difficile stress anxieux ennui ennuyeux 😢 😭 😡 😤 😰 😥 💔 😞"
).split()
# Words in an episode's entities that keep it open.
OPEN_WORDS = ["?", "à faire", "todo", "en cours", "prévu", "attente", "décision", "deadline", "projet", "bloquer", "bloqué"]
# Words that are no entity when they stand alone or lead.
PRONOUNS = (
    "je tu il elle on nous vous ils elles me te se le la les lui leur moi toi ce ça ceci cela qui que quoi dont où mon ton son ma ta sa mes tes ses notre votre nos vos leurs "
    "i my mine you your yours he him his she her hers it its we us our ours they them their theirs this that these those who whom whose which what"
).split()
LEADING = PRONOUNS + (
    "un une des du de cet cette ces the a an pour dans sur sous avec sans en entre vers par avant après depuis pendant comme selon contre for in on at with without from to by about "
    "between after before during chacun chacune tout tous toute toutes rien personne quelqu'un certains certaines deux trois quatre cinq quelques plusieurs petit petite grand grande bon bonne "
    "vrai vraie beau belle joli jolie"
).split()
INTERJECTIONS = "oh ah oula oulala ohla nop nope hein bah bof pfff hmm hum mdr lol wow ouf oups ok okay hello bonjour salut coucou hey hi bravo courage".split()
MEDIA = ["médias", "<médias omis>", "média omis", "image omise", "vidéo omise", "audio omis", "sticker omis", "gif omis", "document omis", "media omitted", "image omitted", "video omitted"]

EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{2600}-\x{26FF}\x{FE00}-\x{FE0F}\x{200B}-\x{200F}]"
LETTERS = "a-zA-ZàâäéèêëïîôùûüÿçÀÂÄÉÈÊËÏÎÔÙÛÜŸÇ"
VOWELS = "aeiouyàâéèêëïîôùûü"


def is_noise(text: Column, least: int = 4) -> Column:
    """Emoji, links, fillers and fragments of less than ``least`` letters; text in other scripts counts as noise."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, EMOJI, ""), r"(?i)https?://\S+", ""))
    letters = F.regexp_replace(bare, f"[^{LETTERS}]", "")
    filler = F.regexp_replace(F.lower(bare), r"^[!?.,… ]+|[!?.,… ]+$", "").isin(FILLERS)
    monotone = (F.size(F.array_distinct(F.split(F.lower(letters), ""))) <= 2) & (F.length(letters) < 10)
    return F.coalesce((F.length(letters) < least) | filler | monotone, F.lit(True))


def is_structural_entity(form: Column, least: int = 2, most: int = 50) -> Column:
    """Whether a surface form can be an entity by its shape."""
    s = F.trim(form)
    low = F.lower(s)
    words = F.split(s, r"\s+")
    letters = F.regexp_replace(low, r"[^\p{L}]", "")
    vowels = F.length(F.regexp_replace(low, f"[^{VOWELS}]", ""))
    return F.coalesce(
        F.length(s).between(least, most) & s.rlike(r"\p{L}") & ~s.rlike(EMOJI) & ~s.rlike(r"(.)\1{2}") & ~low.isin(MEDIA + PRONOUNS + INTERJECTIONS)
        & ~((F.size(words) >= 2) & F.lower(words[0]).isin(LEADING)) & (vowels / F.nullif(F.length(letters), F.lit(0)) >= 0.15)
        & ~((F.size(words) == 1) & s.rlike(r"[0-9]")) & (F.size(words) <= 4),
        F.lit(False),
    )


def is_media(text: Column) -> Column:
    return text.rlike(r"(?i)https?://\S+") | (F.length(F.trim(text)) < 15)


# Patterns of the extractors and their confidences.
EXTRACTORS = {
    "EMAIL": (r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b", 0.99),
    "HANDLE": (r"(@[A-Za-z0-9_]{2,30})\b", 0.90),
    "URL": (r"((?i:https?://|www\.)[^\s<>\"']+)", 0.99),
    "PHONE": (r"((?:\+\d{1,3}[\s.-]?)?\(?\d{2,4}\)?[\s.-]?\d{2,4}[\s.-]?\d{2,4}(?:[\s.-]?\d{2,4})?)", 0.80),
}


def extract(text: Column, kind: str) -> Column:
    """All matches of an extractor; telephone numbers keep 7 to 15 digits and no 20yymmdd dates."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EXTRACTORS[kind][0]), F.lit(1))
    if kind != "PHONE":
        return found
    digits = lambda x: F.regexp_replace(x, r"[^0-9]", "")
    return F.filter(found, lambda x: F.length(digits(x)).between(7, 15) & ~digits(x).rlike("^20[0-9]{6}$"))


def normalise_form(form: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(form)), r"(?U)[^\w@.\-\s]", ""), r"(?U)\s+", " "))


def mood(text: Column) -> Column:
    """Share of positive among all lexicon words that occur in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda lexicon: F.size(F.filter(F.array(*[F.lit(w) for w in lexicon]), lambda w: F.contains(low, w)))
    pos, neg = count(POSITIVE), count(NEGATIVE)
    ratio = pos / (pos + neg)
    return F.when(pos + neg == 0, "neutral").when(ratio > 0.7, "positive").when(ratio < 0.3, "negative").otherwise("mixed")


def preview(text: Column, n: int = 120) -> Column:
    flat = F.regexp_replace(text, "\n", " ")
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def canonical_score(alias: Column) -> Column:
    """Ten points a word, one a letter, five for a capital: the fullest spelling names the entity."""
    return 10 * F.size(F.split(F.trim(alias), r"\s+")) + F.length(alias) + F.when(alias.rlike(r"\p{Lu}"), 5).otherwise(0)


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def ratio_udf():
    """Longest-matching-blocks ratio of two strings; there is no built-in for it, so it runs in Arrow batches."""
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b)])

    return ratio


def string_similarity(a: Column, b: Column) -> Column:
    """Best of the block ratio, token Jaccard, and .8 when one contains the other's bulk."""
    shorter, longer = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    inside = F.contains(longer, shorter) & (F.length(shorter) >= 4) & (F.length(shorter) >= 0.4 * F.length(longer))
    return F.greatest(ratio_udf()(a, b), token_jaccard(a, b), F.when(inside, 0.8).otherwise(0.0))


# What an artifact's type and its words say about its goal.
GOAL_TYPES = {
    "message": "informal communication exchange", "email": "formal written communication", "note": "personal note-taking", "document": "creating or editing a document",
    "reunion": "meeting coordination", "decision": "making a decision", "task": "planning a task",
}
GOAL_WORDS = {
    "demand|request|ask|demande|besoin": "open problem or unresolved question", "décidé|décision|validé|confirmé|ok go": "decision reached or outcome confirmed",
    "chargé|responsable|deadline|pour lundi": "task assigned with a clear owner", "urgent|important|problème|bloqué|incroyable": "emotionally charged or high-stakes exchange",
    "tu te souviens|comme on avait|suite à|rappel": "reactivating or referencing a past episode",
}
# Words of a model's reply that is no JSON.
YES_WORDS, NO_WORDS = "true|oui|nouveau", "false|non|continue"


def goal_phrases(text: Column, artifact_type: Column, entities: Column) -> Column:
    """Phrases for the goal of an artifact: by its type, by the words in it, and its first four entities."""
    types = F.create_map(*[F.lit(x) for pair in GOAL_TYPES.items() for x in pair])
    kind = F.coalesce(F.element_at(types, artifact_type), F.lit("general activity"))
    by_word = [F.when(text.rlike(rf"(?iU)\b({words})\b"), phrase) for words, phrase in GOAL_WORDS.items()]
    named = F.when(F.size(entities) > 0, F.concat(F.lit("related to "), F.array_join(F.slice(entities, 1, 4), ", ")))
    return F.filter(F.array(kind, *by_word, named), lambda x: x.isNotNull())


def boundary_probability(reply: Column) -> Column:
    """Probability in a model's reply: JSON, else keywords; the confidence counts for what it says."""
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "boundary boolean, confidence double")
    yes, conf = parsed["boundary"], F.coalesce(F.least(F.greatest(parsed["confidence"], F.lit(0.0)), F.lit(1.0)), F.lit(0.5))
    low = F.lower(reply)
    fallback = F.when(low.rlike(YES_WORDS), 0.6).when(low.rlike(NO_WORDS), 0.4).otherwise(0.7)
    return F.when(yes.isNull(), fallback).when(yes, conf).otherwise(1 - conf)
