"""Extractive episode summaries: TF-IDF keywords, quotes, labels and narratives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that no keyword list needs.
STOPWORDS = (
    "les des une est que qui dans pour pas sur avec elle nous vous ils elles ses aux mon mes ton tes mais donc car bien très plus aussi quoi comment quand moi toi lui eux cette ces dont par tout "
    "même alors depuis avant après pendant entre sous vers chez sans lors être avoir faire sont fait the are was were been being have has had does did will would could should may might shall can and "
    "but nor not for with from about into over after you she they him her them your his its our their this that these those what which who whom than too very just don now here there when where how "
    "all each every both few more most other some such only own same oui non lol mdr haha bah euh hey bon ben hein null yes yeah nah wow"
).split()


def tokens(text: Column) -> Column:
    """Words of three letters or more that are no stop words, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-zà-ÿ]{3,})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def tfidf_keywords(docs: DataFrame, key: str, text: str, top: int = 10, max_df: float = 0.85, max_features: int = 2000) -> DataFrame:
    """``key, term, weight, rank``: the strongest terms of each document.

    Smooth inverse document frequency ln((1 + N) / (1 + df)) + 1, unit length per document; terms
    in more than ``max_df`` of the documents are left out and the ``max_features`` most frequent of
    the rest kept (ties by term). Terms are counted per document before anything is shuffled by term.
    """
    counts = docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    total = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).crossJoin(F.broadcast(total)).where(F.col("df") <= max_df * F.col("n_docs"))
    kept = terms.orderBy(F.col("cf").desc(), "term").limit(max_features)  # the feature bound of the method
    idf = (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf")
    weighed = counts.join(F.broadcast(kept.select("term", idf)), "term").withColumn("w", F.col("tf") * F.col("idf"))
    by = Window.partitionBy(key)
    unit = weighed.withColumn("weight", F.round(F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(by)), 6))
    return unit.withColumn("rank", F.row_number().over(by.orderBy(F.col("weight").desc(), "term"))).where(F.col("rank") <= top).select(key, "term", "weight", "rank")


def quote_score(similarity: Column, text: Column) -> Column:
    return 0.7 * similarity + 0.3 * F.log1p(F.length(text)) / 10


def pick_quotes(scored: Column, most: int = 3, most_overlap: float = 0.6) -> Column:
    """Greedy choice from an array of ``struct<score, text>`` sorted best first: no two quotes share too many words."""
    words = lambda t: F.array_distinct(F.split(F.lower(t), r"\s+"))
    near = lambda t, q: F.size(F.array_intersect(words(t), words(q))) / F.size(F.array_union(words(t), words(q))) > most_overlap
    step = lambda acc, x: F.when((F.size(acc) >= most) | F.exists(acc, lambda q: near(x["text"], q)), acc).otherwise(F.concat(acc, F.array(x["text"])))
    return F.aggregate(scored, F.array().cast("array<string>"), step)


def label(entities: Column, keywords: Column, quote: Column) -> Column:
    """Entities first, else keywords, at most eight words; else a quote; else a general name."""
    made = F.when(F.size(entities) > 0, F.concat_ws(", ", F.slice(entities, 1, 3))).when(F.size(keywords) > 0, F.concat_ws(", ", F.slice(keywords, 1, 4)))
    short = F.array_join(F.slice(F.split(made, " "), 1, 8), " ")
    return F.coalesce(short, F.when(F.length(F.trim(quote)) > 0, F.substring(quote, 1, 60)), F.lit("Conversation générale"))


def narrative(authors: Column, n: Column, time: Column, keywords: Column, mood: Column) -> Column:
    return F.concat_ws(
        " ", F.concat(n.cast("string"), F.lit(" messages")), F.when(F.size(authors) > 0, F.concat(F.lit("de "), F.array_join(F.array_sort(authors), ", "))), F.concat(F.lit("("), time, F.lit(").")),
        F.when(F.size(keywords) > 0, F.concat(F.lit("Sujets : "), F.array_join(keywords, ", "), F.lit("."))), F.concat(F.lit("Ton : "), mood, F.lit(".")),
    )


def head_middle_tail(df: DataFrame, episode: str, order: str, part: int = 10) -> DataFrame:
    """Rows of long episodes thinned to their first, evenly spaced middle and last rows; others whole."""
    w = Window.partitionBy(episode)
    x = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    step = F.greatest(F.lit(1), F.floor((F.col("_n") - 2 * part) / part))
    middle = (F.col("_i") >= part) & (F.col("_i") < F.col("_n") - part) & ((F.col("_i") - part) % step == 0) & ((F.col("_i") - part) / step < part)
    return x.where((F.col("_n") <= 3 * part) | (F.col("_i") < part) | (F.col("_i") >= F.col("_n") - part) | middle).drop("_i", "_n")
