"""Dictionaries learnt from the data: vocabularies, repairs, odds of tokens, places."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Digits that stand for letters in scanned names, and the costs of words that a domain is made of.
DIGIT_LETTERS = {"0": "o", "1": "li", "3": "e", "4": "a", "5": "s", "6": "g", "8": "b"}


def s1_vocabulary(tokens: DataFrame) -> DataFrame:
    """country, token, n: how many entities' names hold the token (tokens: country, eid, token)."""
    return tokens.select("country", "eid", "token").distinct().groupBy("country", "token").agg(F.count(F.lit(1)).alias("n"))


def best_split(token: str, cost: dict[str, float], least: int = 2, most: int = 4) -> list[str]:
    """The cheapest cut of a token into two to four known words (ties: the earliest cut); [] if there is none."""
    best: list[dict[int, tuple[float, list[str]]]] = [{0: (0.0, [])}] + [{} for _ in token]
    for end in range(1, len(token) + 1):
        for start in range(end):
            word = token[start:end]
            if word not in cost:
                continue
            for n, (total, parts) in best[start].items():
                new = (total + cost[word], parts + [word])
                if n < most and (n + 1 not in best[end] or new < best[end][n + 1]):
                    best[end][n + 1] = new
    found = [v for n, v in best[len(token)].items() if n >= least]
    return min(found)[1] if found else []


def segment_domain(words: DataFrame, vocabulary: DataFrame, affix_cost: float = 3.0) -> DataFrame:
    """country, token, parts: long one-word names cut into words of the country's vocabulary (words: country, token).

    Only vocabulary words that occur in a token reach its group, by a join on the first three letters, so a
    group holds one token and never the vocabulary.
    """
    total = vocabulary.groupBy("country").agg(F.sum("n").alias("total"))
    known = vocabulary.where(F.length("token") >= 3).join(F.broadcast(total), "country").select("country", F.col("token").alias("word"), F.substring("token", 1, 3).alias("head"), (F.log(F.col("total") / F.col("n")) + affix_cost).alias("cost"))
    distinct = words.select("country", "token").distinct()
    heads = distinct.withColumn("head", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("token") - 2, F.lit(1))), lambda i: F.substring("token", i, F.lit(3))))))
    pairs = heads.join(known, ["country", "head"]).where(F.col("token").contains(F.col("word")) & (F.col("token") != F.col("word"))).select("country", "token", "word", "cost").distinct()
    grouped = pairs.groupBy("country", "token").agg(F.sort_array(F.collect_list(F.struct("word", "cost"))).alias("w"))

    @F.pandas_udf(StringType())
    def cut(token: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([" ".join(best_split(t, {x["word"]: x["cost"] for x in own})) for t, own in zip(token, w)])

    return grouped.select("country", "token", cut("token", "w").alias("parts")).where("parts != ''")


def ocr_repair(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """country, token, repaired: words with digits for letters, as the vocabulary's most frequent word that they can stand for (ties: the first)."""
    odd = words.select("country", "token").distinct().where(F.col("token").rlike("[0134568]") & F.col("token").rlike("[a-z]"))
    variants = F.array(F.col("token"))

    def spelt(digit: str, letters: str):
        return lambda t: F.array(*(F.replace(t, F.lit(digit), F.lit(c)) for c in letters))

    for digit, letters in DIGIT_LETTERS.items():
        variants = F.flatten(F.transform(variants, spelt(digit, letters)))
    each = odd.select("country", F.col("token"), F.explode(F.array_distinct(variants)).alias("w")).where("w != token")
    hit = each.join(vocabulary.select("country", F.col("token").alias("w"), "n"), ["country", "w"])
    return hit.withColumn("_k", F.row_number().over(W.partitionBy("country", "token").orderBy(F.desc("n"), "w"))).where("_k = 1").select("country", "token", F.col("w").alias("repaired"))


def extra_name_tokens(tokens: DataFrame, repairs: DataFrame) -> DataFrame:
    """eid and all its tokens: its own, in order, then those that repairs (country, token, parts) add."""
    more = tokens.join(repairs, ["country", "token"]).select("eid", "pos", F.posexplode(F.split("parts", " ")).alias("p", "token"))
    rows = tokens.select("eid", F.lit(0).alias("extra"), "pos", F.lit(0).alias("p"), "token").unionByName(more.select("eid", F.lit(1).alias("extra"), "pos", "p", "token"))
    return rows.groupBy("eid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("extra", "pos", "p", "token"))), lambda x: x["token"]), " ").alias("tokens"))


def pair_dictionary(pairs: DataFrame, left: DataFrame, right: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """t, w, n: the token of the other side that most often stands beside t in true pairs (left, right: eid, token)."""
    both = pairs.join(left.select(F.col("eid").alias("s1"), F.col("token").alias("w")).distinct(), "s1").join(right.select(F.col("eid").alias("r"), F.col("token").alias("t")).distinct(), "r")
    size = pairs.join(right.select(F.col("eid").alias("r"), F.col("token").alias("t")).distinct(), "r").groupBy("t").agg(F.count(F.lit(1)).alias("total"))
    best = both.groupBy("t", "w").agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.row_number().over(W.partitionBy("t").orderBy(F.desc("n"), "w"))).where("_k = 1")
    return best.join(size, "t").where((F.col("n") >= least) & (F.col("n") / F.col("total") >= share) & (F.col("t") != F.col("w"))).select("t", "w", "n")


def token_log_odds(rows: DataFrame, prior: float = 20.0) -> DataFrame:
    """token, grp, odds: log-odds that a pair with the token is true, shrunk to the mean, from the other groups (rows: token, grp, y); group -1 uses all."""
    each = rows.groupBy("token", "grp").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    total = each.groupBy("token").agg(F.sum("y").alias("ty"), F.sum("n").alias("tn"))
    own = each.join(total, "token").select("token", "grp", (F.col("ty") - F.col("y")).alias("y"), (F.col("tn") - F.col("n")).alias("n")).unionByName(total.select("token", F.lit(-1).cast("long").alias("grp"), F.col("ty").alias("y"), F.col("tn").alias("n")))
    base = each.groupBy("grp").agg(F.sum("y").alias("gy"), F.sum("n").alias("gn"))
    every = base.agg(F.sum("gy").alias("ay"), F.sum("gn").alias("an"))
    rate = base.join(F.broadcast(every)).select("grp", ((F.col("ay") - F.col("gy")) / (F.col("an") - F.col("gn"))).alias("rate")).unionByName(every.select(F.lit(-1).cast("long").alias("grp"), (F.col("ay") / F.col("an")).alias("rate")))
    p = (F.col("y") + prior * F.col("rate")) / (F.col("n") + prior)
    z = lambda x: F.log(x / (1 - x))
    return own.join(F.broadcast(rate), "grp").select("token", "grp", F.round(z(p) - z(F.col("rate")), 6).alias("odds"))


def token_moved_rate(rows: DataFrame, prior: float = 20.0) -> DataFrame:
    """country, token, rate: share of pairs with the token whose number moved, shrunk to the country's share (rows: country, token, moved 0/1)."""
    mean = rows.groupBy("country").agg(F.avg("moved").alias("mean"))
    each = rows.groupBy("country", "token").agg(F.sum("moved").alias("m"), F.count(F.lit(1)).alias("n"))
    return each.join(F.broadcast(mean), "country").select("country", "token", F.round((F.col("m") + prior * F.col("mean")) / (F.col("n") + prior), 6).alias("rate"), "n")


def rate_to_odds_map(rates: DataFrame, odds: DataFrame, points: int = 201) -> DataFrame:
    """rate, odds: a falling map from moved rates to odds, fitted by weighted isotonic regression (weights: root of the support) and read at even points."""
    from pyspark.ml.regression import IsotonicRegression

    rows = rates.join(odds.where("grp = -1").select("token", "odds"), "token").select(F.col("odds").alias("label"), F.col("rate").alias("x"), F.sqrt("n").alias("weight"))
    model = IsotonicRegression(isotonic=False, featuresCol="x", labelCol="label", weightCol="weight", predictionCol="odds").fit(rows)
    grid = rates.sparkSession.range(points).select((F.col("id") / (points - 1)).alias("x"))
    return model.transform(grid).select(F.col("x").alias("rate"), "odds")


def lo_mix(tokens: DataFrame, odds: DataFrame, proxy: DataFrame, labelled: list[str]) -> DataFrame:
    """country, token, odds: label odds for labelled countries, the proxy's for the others; next to nothing counts as 0."""
    rows = tokens.join(odds.where("grp = -1").select("token", F.col("odds").alias("a")), "token", "left").join(proxy.select("country", "token", F.col("odds").alias("b")), ["country", "token"], "left")
    z = F.coalesce(F.when(F.col("country").isin(labelled), F.col("a")).otherwise(F.col("b")), F.lit(0.0))
    return rows.select("country", "token", F.when(F.abs(z) < 1e-9, 0.0).otherwise(z).alias("odds"))


def city_vocab(places: DataFrame, least: int = 20, region_share: float = 0.002, parent: float = 0.9) -> DataFrame:
    """country, place, n, region: frequent places (places: country, eid, place); a region is the larger one in nearly all its meetings.

    Records with more than six places take no part in meetings, which bounds the pairs of a record.
    """
    p = places.distinct()
    n = p.groupBy("country", "place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    size = places.groupBy("country").agg(F.countDistinct("eid").alias("size"))
    big = p.withColumn("_m", F.count(F.lit(1)).over(W.partitionBy("eid"))).where("_m <= 6").join(n, ["country", "place"]).select("country", "eid", "place", "n")
    pairs = big.join(big.select("country", "eid", F.col("place").alias("other"), F.col("n").alias("m")), ["country", "eid"]).where("place != other")
    meets = pairs.groupBy("country", "place").agg(F.avg((F.col("n") > F.col("m")).cast("int")).alias("larger"))
    rows = n.join(meets, ["country", "place"], "left").join(F.broadcast(size), "country")
    return rows.select("country", "place", "n", (F.coalesce(F.col("larger") >= parent, F.lit(False)) & (F.col("n") >= region_share * F.col("size"))).alias("region"))


def name_uniqueness(pairs: DataFrame, entities: DataFrame, records: DataFrame) -> DataFrame:
    """How many entities of the country share the entity's and the record's core name (entities, records: eid, country, core)."""
    n = entities.groupBy("country", "core").agg(F.count(F.lit(1)).alias("n"))
    side = lambda t, key, name: t.join(n, ["country", "core"], "left").select(F.col("eid").alias(key), F.coalesce("n", F.lit(0)).alias(name))
    return pairs.select("s1", "r").join(side(entities, "s1", "n_s1"), "s1").join(side(records, "r", "n_r"), "r").select("s1", "r", "n_s1", "n_r")


def idf_fit(tokens: DataFrame) -> DataFrame:
    """country, token, idf = ln((N+1)/(df+1)) + 1, over all records (tokens: country, eid, token)."""
    n = tokens.groupBy("country").agg(F.countDistinct("eid").alias("n"))
    df = tokens.select("country", "eid", "token").distinct().groupBy("country", "token").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n), "country").select("country", "token", "df", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, 6).alias("idf"))


# keys of records; the arguments are columns of the table, as no Python function may stand inside a lambda

def _pairs_of(a: Column, b: Column, mark: str) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(F.lit(mark), x, F.lit("|"), y))))


def compound_keys(names: Column, words: Column, numbers: Column) -> Column:
    """Unordered pairs of the first four name tokens; the first two numbers with the first three address words, and with the first three name tokens."""
    first = F.slice(names, 1, 4)
    two = F.flatten(F.transform(first, lambda x, i: F.transform(F.slice(first, i + 2, 4), lambda y: F.concat(F.lit("nn:"), F.least(x, y), F.lit("|"), F.greatest(x, y)))))
    some = F.slice(numbers, 1, 2)
    return F.concat(two, _pairs_of(some, F.slice(words, 1, 3), "dw:"), _pairs_of(some, F.slice(names, 1, 3), "dn:"))


def name_word_keys(names: Column, words: Column, most: int, streets: list[str]) -> Column:
    """The first two name tokens with the first ``most`` address words of four letters or more that are no street types."""
    plain = F.filter(words, lambda w: (F.length(w) >= 4) & ~F.array_contains(F.array(*map(F.lit, streets)), w))
    return _pairs_of(F.slice(names, 1, 2), F.slice(plain, 1, most), "nw:")


def record_keys(names: Column, words: Column, numbers: Column, joined: Column, skeletons: Column, name_words: int = 0, streets: list[str] | None = None) -> Column:
    """All keys of a record: names and the joined name (n), address words (a), numbers (d), skeletons (k) and compounds; distinct."""
    mark = lambda values, m: F.transform(values, lambda x: F.concat(F.lit(m), x))
    own = F.when(joined.isNull(), names).otherwise(F.concat(names, F.array(joined)))
    parts = [mark(own, "n:"), mark(words, "a:"), mark(numbers, "d:"), mark(skeletons, "k:"), compound_keys(names, words, numbers)]
    if name_words:
        parts.append(name_word_keys(names, words, name_words, streets or []))
    return F.array_distinct(F.concat(*parts))


def nearest_s1(s1_keys: DataFrame, r_keys: DataFrame, most: int = 300) -> DataFrame:
    """Of each record the entity with the largest summed idf of shared keys that at most ``most`` entities have (ties: lower s1)."""
    n = s1_keys.select("eid").distinct().count()
    df = s1_keys.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= most)
    # sides are of the records' size whatever their bytes look like, so none is built in the driver for a broadcast
    left = s1_keys.join(df.hint("merge"), "key").select("key", F.col("eid").alias("s1"), F.log(n / F.col("df")).alias("w"))
    sums = left.hint("merge").join(r_keys.select("key", F.col("eid").alias("r")), "key").groupBy("r", "s1").agg(F.round(F.sum("w"), 6).alias("score"))
    return sums.withColumn("_k", F.row_number().over(W.partitionBy("r").orderBy(F.desc("score"), "s1"))).where("_k = 1").select("s1", "r", "score")


def closeness_bucket(name: Column, address: Column, bar: float = 0.5) -> Column:
    """Which of the two Jaccard similarities reach the bar."""
    a, b = F.coalesce(name, F.lit(0.0)) >= bar, F.coalesce(address, F.lit(0.0)) >= bar
    return F.when(a & b, "both").when(a, "name").when(b, "address").otherwise("neither")


def unambiguous_join(left: DataFrame, right: DataFrame, on: list[str], owned: DataFrame) -> DataFrame:
    """(s1, r) with equal keys where a record meets one entity only and nobody owns it."""
    met = left.join(right, on).select("s1", "r").distinct().withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("r"))).where("_n = 1")
    return met.join(owned.select("r").distinct(), "r", "left_anti").select("s1", "r")


def acronym_join(entities: DataFrame, records: DataFrame, owned: DataFrame) -> DataFrame:
    """Records named by the initials of an entity of the same country and address key (columns country, address, words)."""
    initials = F.array_join(F.transform("words", lambda w: F.substring(w, 1, 1)), "")
    left = entities.where(F.size("words").between(2, 5)).select(F.col("eid").alias("s1"), "country", "address", initials.alias("word"))
    right = records.where(F.size("words") == 1).select(F.col("eid").alias("r"), "country", "address", F.element_at("words", 1).alias("word"))
    return unambiguous_join(left.where("address != ''"), right.where(F.length("word").between(2, 5)), ["country", "address", "word"], owned)


def brand_join(entities: DataFrame, records: DataFrame, owned: DataFrame) -> DataFrame:
    """Records of one word that no entity of the country uses, at an address key that is one entity's only."""
    used = entities.select("country", F.explode("words").alias("word")).distinct()
    right = records.where((F.size("words") == 1) & (F.col("address") != "")).select(F.col("eid").alias("r"), "country", "address", F.element_at("words", 1).alias("word")).where(F.length("word").between(5, 15))
    alone = entities.where("address != ''").withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("country", "address"))).where("_n = 1").select(F.col("eid").alias("s1"), "country", "address")
    return unambiguous_join(alone, right.join(used, ["country", "word"], "left_anti"), ["country", "address"], owned)


def odds_summary(tokens: Column, odds: DataFrame | None = None) -> dict[str, Column]:
    """min (null without any), sum and how many are under -1, of an array of odds."""
    return {"lo_min": F.array_min(tokens), "lo_sum": F.aggregate(tokens, F.lit(0.0), lambda a, b: a + b), "lo_low": F.size(F.filter(tokens, lambda x: x < -1))}


