"""Analysis of questions and texts: stop words, stems, index terms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.functions.stem import stem

# Stop words of questions.
ENGLISH = """
a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing don
down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most
my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them
themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would
you your yours yourself yourselves
""".split()
RUSSIAN = """
а без более больше будет будто бы был была были было быть в вам вас вдруг ведь во вот впрочем все всегда всего всех всю вы где да даже два для до
другой его ее ей ему если есть еще ещё ж же за зачем здесь и из или им иногда их к как какая какие каких какое какой какою какую когда конечно которой
котором которую которые который которым которых кто куда ли либо лучше между меня мне много может можно мой моя мы на над надо наконец нас не него нее
ней нельзя нет ни нибудь никогда ним них ничего но ну о об один он она они опять от откуда перед по под после потом потому почему почти при притом
причём про раз разве с сам свою себе себя сейчас скольких сколько со совсем так также такой там тебя тем теперь то тогда того тоже только том тот три
тут ты у уж уже хорошо хоть чего чей чем через что чтоб чтобы чуть чьи чья чьё эта эти этим этих это этого этой этом этот эту я
""".split()


def stems(terms: DataFrame) -> DataFrame:
    """(term, stem) of the distinct values of ``term``: an Arrow function over the
    vocabulary, which is far smaller than the text it comes from."""

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map(stem)

    return terms.where("term is not null").select("term").distinct().withColumn("stem", of("term"))


def query_terms(queries: DataFrame, stemmed: bool = True) -> DataFrame:
    """(query_id, term, n_terms): the distinct stems of a question's terms without
    stop words (the terms themselves where ``stemmed`` is false); a compound word
    keeps its whole form unstemmed. Null and empty questions have none."""

    def of(word):
        p = F.filter(T.parts(word), lambda x: ~x.isin(*ENGLISH, *RUSSIAN))
        return F.transform(p, lambda x: F.struct(x.alias("term"), F.lit(True).alias("stemmed"))), F.size(p) > 1, F.lower(word)

    def all_of(word):
        p, compound, whole = of(word)
        return F.when(compound, F.concat(p, F.array(F.struct(whole.alias("term"), F.lit(False).alias("stemmed"))))).otherwise(p)

    raw = queries.select("query_id", F.explode(F.flatten(F.transform(T.words(F.col("text")), all_of))).alias("x")).select("query_id", "x.term", "x.stemmed")
    if stemmed:
        vocabulary = stems(raw.where("stemmed"))
        raw = raw.join(vocabulary, "term", "left").select("query_id", F.when(F.col("stemmed"), F.col("stem")).otherwise(F.col("term")).alias("term"))
    done = raw.select("query_id", "term").distinct()
    return done.join(done.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_terms")), "query_id").select("query_id", "term", "n_terms")


def index_terms(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf): stemmed index terms of each text with their frequencies.
    The vocabulary is stemmed once and joined back to the counts."""

    def all_of(word):
        p = F.transform(T.parts(word), lambda x: F.struct(x.alias("term"), F.lit(True).alias("stemmed")))
        return F.when(F.size(p) > 1, F.concat(p, F.array(F.struct(F.lower(word).alias("term"), F.lit(False).alias("stemmed"))))).otherwise(p)

    raw = docs.select(key, F.explode(F.flatten(F.transform(T.words(F.col(text)), all_of))).alias("x")).groupBy(key, "x.term", "x.stemmed").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = stems(raw.where("stemmed"))
    named = raw.join(vocabulary, "term", "left").select(key, F.when(F.col("stemmed"), F.col("stem")).otherwise(F.col("term")).alias("term"), "n")
    return named.groupBy(key, "term").agg(F.sum("n").alias("tf"))
