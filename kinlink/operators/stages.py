"""Whole stages put together from operators: retrieval views, pair features, decisions, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import businesses as B
from ..functions import pairs as P
from ..functions import text as T
from . import decide as D
from . import graph as G
from . import retrieval as R
from .tables import saved

PAIR = ["s1", "r"]
#: Bits of the views, and the sizes of the names-only search.
TOKENS, NAMES_ONLY = 64, 4
SHORT = {"keep": (10, 10), "trim": (5, 5), "verify": (200, 200)}


def name_short_view(s1_names: DataFrame, r_names: DataFrame, sizes: DataFrame, most_words: int = 3, long_name: int = 0, **search) -> DataFrame:
    """Names only, for records whose address has at most ``most_words`` words or whose name is one word of ``long_name`` letters (sizes: eid, n_address, n_name, longest)."""
    few = F.col("n_address") <= most_words
    few = few | ((F.col("n_name") == 1) & (F.col("longest") >= long_name)) if long_name else few
    return R.search_view(s1_names, r_names.join(sizes.where(few).select("eid"), "eid", "left_semi").select(*r_names.columns), **{**SHORT, **search})


def block_stage(s1_keys: DataFrame, r_keys: DataFrame, s1_names: DataFrame, r_names: DataFrame, sizes: DataFrame, **search) -> DataFrame:
    """s1, r, views, and per view its score and ranks (-1 where it did not find the pair). Partitions are a key column, so there is no loop over them."""
    tok = R.search_view(s1_keys, r_keys, **search).select(*PAIR, F.col("score").alias("score_tok"), F.col("rank_s1").alias("rank_s1_tok"), F.col("rank_r").alias("rank_r_tok"))
    short = name_short_view(s1_names, r_names, sizes).select(*PAIR, F.col("score").alias("score_ns"), F.col("rank_s1").alias("rank_s1_ns"), F.col("rank_r").alias("rank_r_ns"))
    # an unlabelled record may meet an entity in several partitions: its best row stays
    once = lambda t, c: t.withColumn("_k", F.row_number().over(W.partitionBy(*PAIR).orderBy(F.desc(c), *[x for x in t.columns if x.startswith("rank")]))).where("_k = 1").drop("_k")
    both = once(tok, "score_tok").join(once(short, "score_ns"), PAIR, "full")
    views = F.when(F.col("score_tok").isNotNull(), TOKENS).otherwise(0) + F.when(F.col("score_ns").isNotNull(), NAMES_ONLY).otherwise(0)
    ranks = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("rank_s1_tok", "rank_r_tok", "rank_s1_ns", "rank_r_ns")]
    return both.select(*PAIR, views.cast("long").alias("views"), "score_tok", "score_ns", *ranks)


def signed_numbers(a: Column, b: Column) -> dict[str, Column]:
    """How the record's first number (b) differs from the entity's (a): signed difference within 50, look-alike steps, one digit, neighbours swapped, ending, length."""
    x, y = a.cast("string"), b.cast("string")
    same = F.length(x) == F.length(y)
    swapped = B.number_edit(x, y) == "swap"
    return {"d": F.greatest(F.least(b - a, F.lit(50)), F.lit(-50)), "nudge": (b - a).isin(*B.NUDGES), "one_digit": same & (F.levenshtein(x, y) == 1), "swap": same & swapped, "suffix": (x != y) & (x.endswith(y) | y.endswith(x)), "length": F.length(y) - F.length(x)}


def number_features(a: Column, b: Column, unit_a: Column, unit_b: Column) -> dict[str, Column]:
    """Relations of two first numbers; null where one is absent, but for ``missing`` and ``unit_equal``."""
    x, y = a.cast("string"), b.cast("string")
    high, low = F.greatest(a, b), F.least(a, b)
    return {"equal": a == b, "truncation": (a != b) & (F.greatest(x, y).startswith(F.least(x, y))), "suffix": (a != b) & (x.endswith(y) | y.endswith(x)), "nudge": F.abs(a - b).between(1, 10), "missing": a.isNull() | b.isNull(), "abs_diff": F.abs(a - b),
            "relative": F.round(F.abs(a - b) / F.greatest(high, F.lit(1)), 6), "same_length": F.length(x) == F.length(y), "unit_equal": F.coalesce(unit_a == unit_b, F.lit(False)), "low": low}


def address_equalities(rows: DataFrame) -> DataFrame:
    """Of normalised sides (prefix l_ and r_): cities and states equal (null if one is empty), street words in common, flags of either side, difference of sizes."""
    c = F.col
    same = lambda n: F.when((c(f"l_{n}") != "") & (c(f"r_{n}") != ""), c(f"l_{n}") == c(f"r_{n}"))
    either = [(c(f"l_{f}") | c(f"r_{f}")).alias(f"either_{f[2:]}") for f in ("f_addr_empty", "f_addr_short", "f_landmark", "f_pobox", "f_addr_null")]
    street = P.jaccard(F.filter(F.split("l_a_street", " "), lambda w: w != ""), F.filter(F.split("r_a_street", " "), lambda w: w != ""))
    return rows.select(*PAIR, same("a_city").alias("city_equal"), same("a_state").alias("state_equal"), F.round(street, 6).alias("street_jaccard"), *either, F.abs(c("l_a_ntok") - c("r_a_ntok")).alias("ntok_diff"))


def extra_features(a: Column, b: Column, idf: DataFrame | None = None) -> dict[str, Column]:
    """Words of each side that no word of the other is within two edits of, and whether such words remain on both."""
    left, right = P.extra_tokens(a, b), P.extra_tokens(b, a)
    return {"s1_extra": F.size(left), "r_extra": F.size(right), "substitution": (F.size(left) > 0) & (F.size(right) > 0)}


def fuzzy_scores(texts: DataFrame) -> DataFrame:
    """Similarities of names and addresses (texts: s1, r, na, nb, aa, ab), null where a side is empty."""
    core = lambda c: F.array_join(T.name_tokens(F.col(c)), " ")
    rows = texts.select(*PAIR, T.fold(F.col("na")).alias("fa"), T.fold(F.col("nb")).alias("fb"), core("na").alias("ca"), core("nb").alias("cb"), T.fold(F.col("aa")).alias("xa"), T.fold(F.col("ab")).alias("xb"))
    joined = rows.select("*", F.replace("ca", F.lit(" "), F.lit("")).alias("ja"), F.replace("cb", F.lit(" "), F.lit("")).alias("jb"))
    f = {"tsort": P.sim_token_sort("fa", "fb"), "partial": P.sim_partial("fa", "fb"), "c_tset": P.sim_token_set("ca", "cb"), "c_ratio": P.sim_ratio("ca", "cb"), "c_jw": P.sim_jaro_winkler("ca", "cb"), "cat_ratio": P.sim_ratio("ja", "jb"), "cat_partial": P.sim_partial("ja", "jb"), "addr_tset": P.sim_token_set("xa", "xb"), "addr_tsort": P.sim_token_sort("xa", "xb")}
    return joined.select(*PAIR, *(F.round(c, 6).alias(n) for n, c in f.items()))


def baseline_pair_features(texts: DataFrame) -> DataFrame:
    """Overlap of names and addresses, relation of the first numbers, three similarities."""
    n, a = (lambda c: T.name_tokens(F.col(c))), (lambda c: T.address_words(F.col(c)))
    number = lambda c: F.get(T.address_numbers(F.col(c)), 0).cast("long")
    rows = texts.select(*PAIR, n("na").alias("x"), n("nb").alias("y"), a("aa").alias("u"), a("ab").alias("v"), number("aa").alias("p"), number("ab").alias("q"))
    return rows.select(*PAIR, F.round(P.jaccard(F.col("x"), F.col("y")), 6).alias("name_jaccard"), F.round(P.containment(F.col("x"), F.col("y")), 6).alias("name_in_r"), F.round(P.jaccard(F.col("u"), F.col("v")), 6).alias("addr_jaccard"), P.number_rel_code(F.col("p"), F.col("q")).alias("number"))


def decide_stage(edges: DataFrame, universe: DataFrame, truth: DataFrame, holdout: Column, grid: list[float]) -> DataFrame:
    """Pairs of all entities under the bar that is best on the holdout's entities."""
    owned = saved(G.argmax_owner(edges))
    sweep = G.tune_threshold(universe.where(holdout), truth.where(holdout), owned.where(holdout), grid)
    bar = D.best_of_sweep(sweep, "t", "macro_f05").first()["t"]
    return owned.where(F.col("p") >= bar).select(*PAIR, "p")


def kit_export(edges: DataFrame, texts: DataFrame, matches: DataFrame, country: DataFrame, name: str) -> DataFrame:
    """One country's candidate pairs with texts, score and whether they are predicted."""
    own = country.where(F.col("country") == name).select("s1")
    return edges.join(own, "s1", "left_semi").join(texts, PAIR).join(matches.select(*PAIR, F.lit(True).alias("predicted")).distinct(), PAIR, "left").na.fill(False, ["predicted"])


def rescore_export(matches: DataFrame, edges: DataFrame, done: DataFrame, low: float = 0.99) -> DataFrame:
    """Predicted pairs above ``low`` that no slow scorer has seen."""
    return edges.where(F.col("p") > low).join(matches.select(*PAIR), PAIR, "left_semi").join(done.select(*PAIR), PAIR, "left_anti").select(*PAIR, "p")


def llm_merge(parts: list[DataFrame], wanted: DataFrame) -> DataFrame:
    """Scores (s1, r, z) of several parts in one table; an error when read if a pair is scored twice or a wanted pair is not."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    each = rows.groupBy(*PAIR).agg(F.first("z").alias("z"), F.count(F.lit(1)).alias("_n"))
    joined = wanted.select(*PAIR).join(each, PAIR, "left")
    bad = F.when(F.col("_n") > 1, F.raise_error(F.lit("a pair is scored twice"))).when(F.col("_n").isNull(), F.raise_error(F.lit("a pair is not scored")))
    return joined.withColumn("_bad", bad.cast("string")).where("_bad IS NULL").select(*PAIR, "z")


def synth_pairs(entities: DataFrame, seed: int = 0) -> DataFrame:
    """Labelled pairs made from entities (eid, name, address): a copy with a typo, swapped words or a lost legal form, and a look-alike with a moved number.

    What is done to a record hangs on a hash of its key, so the table is the same at any partitioning.
    """
    h = F.pmod(F.xxhash64("eid", F.lit(seed)), F.lit(3))
    words = F.split("name", " ")
    middle = F.floor(F.length("name") / 2).cast("int")
    typo = F.concat(F.substring("name", F.lit(1), middle), F.substring("name", middle + 2, F.length("name")))
    copy = F.when(h == 0, typo).when(h == 1, F.array_join(F.reverse(words), " ")).otherwise(F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), " "))
    number = F.regexp_extract("address", "([0-9]+)", 1)
    moved = F.regexp_replace("address", "^([^0-9]*)[0-9]+", F.concat(F.lit("$1"), (F.coalesce(number.try_cast("long"), F.lit(0)) + 2 + h).cast("string")))
    made = F.array(F.struct(copy.alias("name_r"), F.col("address").alias("address_r"), F.lit(1).alias("y")), F.struct(F.col("name").alias("name_r"), F.when(number == "", F.concat("address", F.lit(" 1"))).otherwise(moved).alias("address_r"), F.lit(0).alias("y")))
    return entities.select("eid", "name", "address", F.explode(made).alias("m")).select("eid", "name", "address", "m.*")
