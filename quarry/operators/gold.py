"""Scores of answers against gold artifacts: facts, required sources, penalties and sentences without a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.dims import lookup, strings
from quarry.functions.text import folded

_WS = r"[ \t\n\r\f\x0B]"
# What gold types stand for, which sources are primary, words without meaning, penalties that rules know.
GOLD_TYPES = {"academic": "academic", "news": "other", "primary-document": "filing", "encyclopedic": "encyclopedic", "forum": "forum", "code": "code", "filing": "filing", "government": "government", "medical": "medical"}
PRIMARY_TYPES, PRIMARY_NAMES = ["filing", "government", "medical", "code"], ["sec_edgar", "data_gov", "github", "pubmed"]
EMPTY_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "with"]
NEWS_NAMES = ["news", "reuters", "bloomberg", "apnews", "associated press", "nyt", "wsj"]
PENALTY_RULES = [  # words of the penalty, pattern of the answer
    (["automatically", "hyperinflation"], "automatic.*hyperinflation|hyperinflation.*automatic"),
    (["llm scan as enough"], "llm.*(enough|sufficient)|scan.*enough"),
    (["insider news"], "insider news|inside information"),
    (["consensus as truth"], "consensus.*truth"),
]
CLAIM_WORDS = r"(?i)[0-9]|\b(because|caused|causes|reported|found|increased|decreased|shows|therefore|outperform|beats|proves)\b"


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), _WS + "+", " "))


def meaningful(text: Column) -> Column:
    return _meaningful(folded(text))


def _meaningful(said: Column) -> Column:
    return F.filter(F.split(said, " "), lambda t: (F.length(t) > 2) & ~t.isin(*EMPTY_WORDS))


def fact_hit(answer: Column, fact: Column, keywords: Column) -> Column:
    """Whether any keyword occurs in the answer; without keywords, any of the fact's first five words of six letters or more."""
    own = F.slice(F.filter(F.split(fact, "[^a-z0-9]+"), lambda t: F.length(t) > 5), 1, 5)
    return F.exists(F.when(F.size(keywords) > 0, keywords).otherwise(own), lambda t: F.contains(plain(answer), plain(t)))


def _known(words: Column, have: Column) -> Column:
    """How many of ``words``, repeats counted, are among ``have``; what both hold is found by hashing, not word by word."""
    common = F.array_intersect(words, have)
    return F.when(F.size(common) == 0, 0).otherwise(F.size(F.filter(words, lambda t: F.array_contains(common, t))))


def strict_fact_hit(said: Column, have: Column, keywords: Column, own: Column) -> Column:
    """Of an answer's folded text and meaningful words: whether all of one or two keywords or 3 of 4 of more occur, or 55 % of the fact's meaningful words and three. Keywords are folded."""
    n = F.size(keywords)
    hits = F.size(F.filter(keywords, lambda t: F.contains(said, t)))
    return ((n > 0) & (hits >= F.when(n <= 2, n).otherwise(F.ceil(n * 0.75)))) | ((F.size(own) > 0) & (_known(own, have) >= F.greatest(F.lit(3), F.ceil(F.size(own) * 0.55))))


def penalty_hit(answer: Column, penalty: Column) -> Column:
    """Whether the answer falls under a penalty that a rule knows."""
    out = F.lit(False)
    for words, pattern in reversed(PENALTY_RULES):
        told = F.lit(True)
        for w in words:
            told = told & F.contains(plain(penalty), F.lit(w))
        out = F.when(told, plain(answer).rlike(pattern)).otherwise(out)
    return out


def strict_penalty_hit(said: Column, have: Column, penalty: Column, own: Column) -> Column:
    """Of the same: whether the answer says the penalty, or four fifths of its meaningful words, of which it has three. The penalty is folded."""
    return (penalty != "") & (F.contains(said, penalty) | ((F.size(own) >= 3) & (_known(own, have) >= F.ceil(F.size(own) * 0.8))))


def is_primary(source: Column) -> Column:
    return F.coalesce((source["provenance"] == "primary") | source["source_type"].isin(*PRIMARY_TYPES) | source["source_name"].isin(*PRIMARY_NAMES), F.lit(False))


def required_hit(sources: Column, kind: Column) -> Column:
    """Whether a cited source has the type that a required one stands for, or any is primary."""
    return F.exists(sources, lambda s: F.coalesce((s["source_type"] == lookup(GOLD_TYPES, kind)) | (s["provenance"] == "primary"), F.lit(False)))


def strict_required_hit(sources: Column, kind: Column) -> Column:
    """Whether a cited source is of the type itself; a primary document and news have rules of their own."""
    said = lambda s: folded(F.concat_ws(" ", s["source_name"], s["title"], s["url"]))
    news = lambda s: F.exists(strings(NEWS_NAMES), lambda n: F.contains(said(s), n))
    return F.when(kind == "primary-document", F.exists(sources, is_primary)).when(kind == "news", F.exists(sources, news)).otherwise(F.exists(sources, lambda s: F.coalesce(s["source_type"] == kind, F.lit(False))))


def sentences(text: Column, marks: str = ".") -> Column:
    """Sentences behind any of the marks."""
    said = F.regexp_replace(text, rf"([{marks}]){_WS}+", "$1\x01")
    return F.filter(F.transform(F.split(said, "\x01"), lambda s: F.regexp_replace(s, rf"^{_WS}+|{_WS}+$", "")), lambda s: s != "")


def score(answers: DataFrame, gold: DataFrame, strict: bool = False) -> DataFrame:
    """One row an answer: facts and required sources hit, penalties, primary sources, sentences without a source, status.

    ``answers``: (engine, question_id, answer, sources: array of structs source_name, source_type, url, title, provenance);
    ``gold``: (question_id, valid, facts: array of structs text, keywords; required: array of types; penalties). An answer
    without gold, or with an invalid one, is blocked; an empty answer cannot be scored.
    """
    none = F.array().cast("array<string>")
    if strict:  # gold is folded once a question, before it meets the answers
        words = lambda f: F.struct(f["text"].alias("text"), F.transform(f["keywords"], folded).alias("keywords"), meaningful(f["text"]).alias("own"))
        told = lambda p: F.struct(p.alias("text"), folded(p).alias("said"), meaningful(p).alias("own"))
        gold = gold.withColumn("facts", F.transform("facts", words)).withColumn("penalties", F.transform("penalties", told))
    dealt = answers.repartition(int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few files may hold many answers
    a = dealt.join(gold, "question_id", "left").withColumn("said", folded(F.coalesce("answer", F.lit("")))).withColumn("have", F.array_distinct(_meaningful(F.col("said"))))
    said, have = F.col("said"), F.col("have")
    empty = lambda c: F.coalesce(c, F.array().cast(a.schema[c].dataType))
    facts, required, penalties = empty("facts"), empty("required"), empty("penalties")
    answer, sources = F.coalesce("answer", F.lit("")), F.col("sources")
    status = F.when(F.trim(answer) == "", "scoring_unavailable").when(F.col("valid").isNull(), "blocked_missing_gold").when(~F.col("valid"), "blocked_invalid_gold").otherwise("scored")
    hit_fact = (lambda f: strict_fact_hit(said, have, f["keywords"], f["own"])) if strict else (lambda f: fact_hit(answer, f["text"], f["keywords"]))
    hit_penalty = (lambda p: strict_penalty_hit(said, have, p["said"], p["own"])) if strict else (lambda p: penalty_hit(answer, p))
    hit_source = strict_required_hit if strict else required_hit
    scored = status == "scored"
    count = lambda c: F.when(scored, F.size(c)).otherwise(0)
    if strict:
        primary = F.size(F.array_distinct(F.transform(F.filter(sources, is_primary), lambda s: F.coalesce(s["url"], F.concat(F.coalesce(s["source_name"], F.lit("unknown")), F.lit(":"), F.coalesce(s["title"], F.lit("")))))))
        claims = F.slice(F.filter(sentences(F.regexp_replace(answer, _WS + "+", " "), ".!?"), lambda s: (F.length(s) >= 35) & s.rlike(CLAIM_WORDS)), 1, 5)
    else:
        primary = F.size(F.filter(sources, lambda s: F.coalesce((s["provenance"] == "primary") | s["source_type"].isin("filing", "government"), F.lit(False))))
        claims = F.slice(F.filter(sentences(answer), lambda s: F.length(s) > 80), 1, 3)
    fallen = F.filter(penalties, hit_penalty)
    fallen = F.transform(fallen, lambda p: p["text"]) if strict else fallen
    return a.select(
        "engine", "question_id", status.alias("score_status"), count(F.filter(facts, hit_fact)).alias("facts_hit"), F.size(facts).alias("facts_total"),
        count(F.filter(required, lambda r: hit_source(sources, r))).alias("required_hit"), F.size(required).alias("required_total"), F.when(scored, primary).otherwise(0).alias("primary_sources"),
        F.when(scored, fallen).otherwise(none).alias("penalties_hit"), F.when(scored & (F.size(sources) == 0), claims).otherwise(none).alias("unsourced"),
    )
