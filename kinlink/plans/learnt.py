"""Queries of learnt dictionaries and of record keys, on the business records, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import businesses as B
from ..functions import pairs as P
from ..functions import text as T
from ..operators import dictionaries as L
from ..operators import retrieval as R
from ..operators.tables import saved
from .businesses import _ATEXT, _AWORDS, _B, _CITIES, _CONTENT, _FOLDED, _STOP, biz, words
from .catalogue import _KEYS, _TRIMMED, CHECKED, SEEDS, _sides, records
from .registry import query

_NT = f"list_filter(string_split_regex({_FOLDED.format('name')}, '[^a-z0-9]+'), lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t))"
_TOK = f"{_B}, tok AS (SELECT country, k AS eid, v, pos, token FROM (SELECT country, k, v, unnest({_NT}) AS token, generate_subscripts({_NT}, 1) - 1 AS pos FROM biz)), voc AS (SELECT country, token, count(DISTINCT eid) AS n FROM tok WHERE v = 0 GROUP BY ALL)"


def tokens(spark, d):
    return biz(spark, d).select("country", F.col("k").alias("eid"), "v", F.posexplode(T.name_tokens(F.col("name"))).alias("pos", "token"))


def vocabulary(spark, d):
    return L.s1_vocabulary(tokens(spark, d).where("v = 0"))


query("s1_vocabulary", f"WITH {_TOK} SELECT * FROM voc")(vocabulary)
_GLUED = "glued AS (SELECT DISTINCT a.country, a.token || b.token AS token FROM tok a JOIN tok b ON a.eid = b.eid AND a.pos = 0 AND b.pos = 1 WHERE a.v = 1)"


def glued(spark, d):
    t = tokens(spark, d).where("v = 1")
    return t.where("pos = 0").join(t.where("pos = 1").select("eid", F.col("token").alias("b")), "eid").select("country", F.concat("token", "b").alias("token")).distinct()


query("segment_domain", f"""WITH {_TOK}, {_GLUED}, c AS (SELECT g.country, g.token, v.token || ' ' || w.token AS parts, ln(z.t / v.n) + ln(z.t / w.n) + 6 AS cost FROM glued g JOIN voc v ON v.country = g.country AND starts_with(g.token, v.token) JOIN voc w ON w.country = g.country AND v.token || w.token = g.token JOIN (SELECT country, sum(n) AS t FROM voc GROUP BY country) z ON z.country = g.country WHERE length(v.token) >= 3 AND length(w.token) >= 3)
  SELECT country, token, parts FROM (SELECT *, row_number() OVER (PARTITION BY country, token ORDER BY cost, parts) AS k FROM c) WHERE k = 1""")(lambda spark, d: L.segment_domain(glued(spark, d), vocabulary(spark, d)))
_OCR = "odd AS (SELECT DISTINCT country, replace(replace(token, 'o', '0'), 's', '5') AS token FROM tok WHERE v = 1 AND (token LIKE '%o%' OR token LIKE '%s%'))"


def odd(spark, d):
    return tokens(spark, d).where("v = 1 AND (token LIKE '%o%' OR token LIKE '%s%')").select("country", F.expr("replace(replace(token, 'o', '0'), 's', '5')").alias("token")).distinct()


query("ocr_repair", f"WITH {_TOK}, {_OCR} SELECT country, token, repaired FROM (SELECT o.country, o.token, v.token AS repaired, row_number() OVER (PARTITION BY o.country, o.token ORDER BY n DESC, v.token) AS k FROM odd o JOIN voc v ON v.country = o.country AND replace(replace(v.token, 'o', '0'), 's', '5') = o.token) WHERE k = 1")(
    lambda spark, d: L.ocr_repair(odd(spark, d), vocabulary(spark, d)))
query("extra_name_tokens", f"WITH {_TOK}, rep AS (SELECT DISTINCT country, token, token || 's extra' AS parts FROM tok WHERE pos = 0), r AS (SELECT eid, 0 AS extra, pos, 0 AS p, token FROM tok UNION ALL SELECT eid, 1, pos, 0, token || 's' FROM tok WHERE (country, token) IN (SELECT (country, token) FROM rep) UNION ALL SELECT eid, 1, pos, 1, 'extra' FROM tok WHERE (country, token) IN (SELECT (country, token) FROM rep)) SELECT eid, string_agg(token, ' ' ORDER BY extra, pos, p) AS tokens FROM r GROUP BY eid")(
    lambda spark, d: L.extra_name_tokens(tokens(spark, d), tokens(spark, d).where("pos = 0").select("country", "token", F.concat("token", F.lit("s extra")).alias("parts")).distinct()))
_TRUE = "true_pairs AS (SELECT a.k AS s1, b.k AS r, a.country FROM biz a JOIN biz b USING (g) WHERE a.v = 0 AND b.v > 0)"


def true_pairs(spark, d):
    b = biz(spark, d)
    return b.where("v = 0").select("g", "country", F.col("k").alias("s1")).join(b.where("v > 0").select("g", F.col("k").alias("r")), "g").select("s1", "r", "country")


query("indic_dict", f"""WITH {_TOK}, {_TRUE}, c AS (SELECT b.token AS t, a.token AS w, count(*) AS n FROM true_pairs p JOIN tok a ON a.eid = p.s1 JOIN tok b ON b.eid = p.r GROUP BY ALL), z AS (SELECT t, count(*) AS total FROM (SELECT p.r, p.s1, b.token AS t FROM true_pairs p JOIN tok b ON b.eid = p.r) GROUP BY t)
  SELECT t, w, n FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, w) AS k FROM c) JOIN z USING (t) WHERE k = 1 AND n >= 5 AND n / total >= 0.5 AND t <> w""")(
    lambda spark, d: L.pair_dictionary(true_pairs(spark, d).select("s1", "r"), tokens(spark, d), tokens(spark, d)))
_ODDS = f"""{_TOK}, y AS (SELECT token, CAST(eid % 3 AS BIGINT) AS grp, CASE WHEN eid % 5 < 2 THEN 1 ELSE 0 END AS y FROM tok), e AS (SELECT token, grp, sum(y) AS y, count(*) AS n FROM y GROUP BY ALL), g AS (SELECT grp, sum(y) AS y, count(*) AS n FROM y GROUP BY grp),
  own AS (SELECT a.token, a.grp, sum(b.y) - any_value(a.y) AS y, sum(b.n) - any_value(a.n) AS n FROM e a JOIN e b USING (token) GROUP BY a.token, a.grp UNION ALL SELECT token, -1, sum(y), sum(n) FROM e GROUP BY token),
  rate AS (SELECT grp, ((SELECT sum(y) FROM g) - y) / ((SELECT sum(n) FROM g) - n) AS rate FROM g UNION ALL SELECT -1, (SELECT sum(y) FROM g) / (SELECT sum(n) FROM g)),
  odds AS (SELECT token, grp, round(ln(p / (1 - p)) - ln(rate / (1 - rate)), 6) + 0.0 AS odds FROM (SELECT token, grp, rate, (y + 20 * rate) / (n + 20) AS p FROM own JOIN rate USING (grp)))"""


def odds(spark, d):
    return L.token_log_odds(tokens(spark, d).select("token", (F.col("eid") % 3).cast("long").alias("grp"), (F.col("eid") % 5 < 2).cast("int").alias("y"))).withColumn("odds", F.col("odds") + F.lit(0.0))


def moved(spark, d):
    return L.token_moved_rate(tokens(spark, d).select("country", "token", (F.col("eid") % 4 == 0).cast("int").alias("moved")))


_MOVED = "m AS (SELECT country, token, CASE WHEN eid % 4 = 0 THEN 1 ELSE 0 END AS moved FROM tok), moved AS (SELECT country, token, round((sum(moved) + 20 * any_value(mean)) / (count(*) + 20), 6) AS rate, count(*) AS n FROM m JOIN (SELECT country, avg(moved) AS mean FROM m GROUP BY country) USING (country) GROUP BY country, token)"
query("token_log_odds", f"WITH {_ODDS} SELECT * FROM odds")(odds)
query("token_moved_rate", f"WITH {_TOK}, {_MOVED} SELECT * FROM moved")(moved)
query("rate_to_odds_map")(lambda spark, d: L.rate_to_odds_map(moved(spark, d), odds(spark, d)))
query("lo_mix", f"WITH {_ODDS}, {_MOVED}, t AS (SELECT DISTINCT country, token FROM tok) SELECT t.country, t.token, CASE WHEN t.country IN ('0', '1') THEN CASE WHEN abs(o.odds) < 1e-9 THEN 0.0 ELSE o.odds END ELSE m.rate END AS odds FROM t LEFT JOIN odds o ON o.token = t.token AND o.grp = -1 LEFT JOIN moved m ON m.country = t.country AND m.token = t.token")(
    lambda spark, d: L.lo_mix(tokens(spark, d).select("country", "token").distinct(), odds(spark, d), moved(spark, d).withColumnRenamed("rate", "odds"), ["0", "1"]))
query("city_vocab", f"""WITH {_B}, p AS (SELECT DISTINCT country, k AS eid, unnest({_CITIES.format('address')}) AS place FROM biz), n AS (SELECT country, place, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 5), b AS (SELECT p.*, n FROM p JOIN n USING (country, place)),
  m AS (SELECT x.country, x.place, avg(CASE WHEN x.n > y.n THEN 1 ELSE 0 END) AS larger FROM b x JOIN b y ON x.country = y.country AND x.eid = y.eid AND x.place <> y.place GROUP BY ALL) SELECT n.country, n.place, n.n, coalesce(larger >= 0.9, false) AND n.n >= 0.002 * z AS region FROM n LEFT JOIN m USING (country, place) JOIN (SELECT country, count(DISTINCT eid) AS z FROM p GROUP BY country) USING (country)""")(
    lambda spark, d: L.city_vocab(biz(spark, d).select("country", F.col("k").alias("eid"), F.explode(B.city_components(F.col("address"))).alias("place")), least=5))
_CORE = f"list_filter(string_split_regex(lower(regexp_replace(strip_accents(name), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains({_STOP}, w))"
query("name_uniqueness", f"WITH {_B}, {_TRUE}, c AS (SELECT country, k, v, array_to_string({_CORE}, ' ') AS core FROM biz), n AS (SELECT country, core, count(*) AS n FROM c WHERE v = 0 GROUP BY ALL) SELECT s1, r, coalesce(x.n, 0) AS n_s1, coalesce(y.n, 0) AS n_r FROM true_pairs p JOIN c a ON a.k = p.s1 JOIN c b ON b.k = p.r LEFT JOIN n x ON x.country = a.country AND x.core = a.core LEFT JOIN n y ON y.country = b.country AND y.core = b.core")(
    lambda spark, d: (lambda c: L.name_uniqueness(true_pairs(spark, d), c.where("v = 0"), c.where("v > 0")))(biz(spark, d).select(F.col("k").alias("eid"), "v", "country", B.core_name_v2(F.col("name")).alias("core"))))
query("idf_fit", f"WITH {_TOK}, n AS (SELECT country, count(DISTINCT eid) AS n FROM tok GROUP BY country) SELECT country, token, count(DISTINCT eid) AS df, round(ln((any_value(n) + 1) / (count(DISTINCT eid) + 1)) + 1, 6) AS idf FROM tok JOIN n USING (country) GROUP BY country, token")(lambda spark, d: L.idf_fit(tokens(spark, d)))

# keys



def name_parts():
    return T.name_tokens(F.col("name"))


def address_parts():
    return T.address_words(F.col("address"))


def number_parts():
    return T.address_numbers(F.col("address"))


_NUMS = f"list_transform(regexp_extract_all({_ATEXT}, '[0-9]+'), lambda t: regexp_replace(t, '^0+([0-9])', '\\1'))"
_F = f"{_B}, f AS (SELECT k, g, v, country, {_NT} AS n, {_AWORDS} AS a, {_NUMS} AS d FROM biz)"
_COMPOUND = """SELECT k, 'nn:' || least(n[i], n[j]) || '|' || greatest(n[i], n[j]) AS key FROM f, range(1, 4) x(i), range(2, 5) y(j) WHERE i < j AND j <= least(len(n), 4) UNION SELECT k, 'dw:' || d[i] || '|' || a[j] FROM f, range(1, 3) x(i), range(1, 4) y(j) WHERE i <= len(d) AND j <= len(a) UNION SELECT k, 'dn:' || d[i] || '|' || n[j] FROM f, range(1, 3) x(i), range(1, 4) y(j) WHERE i <= len(d) AND j <= len(n)"""
_STREET = "[" + ", ".join(f"'{w}'" for w in sorted(set(T.STREET.values()))) + "]"
_NW = f"SELECT k, 'nw:' || n[i] || '|' || w[j] AS key FROM (SELECT *, list_filter(a, lambda x: length(x) >= 4 AND NOT list_contains({_STREET}, x)) AS w FROM f), range(1, 3) x(i), range(1, 4) y(j) WHERE i <= len(n) AND j <= len(w)"


def parts(spark, d):
    return biz(spark, d).select("*", name_parts().alias("n_"), address_parts().alias("a_"), number_parts().alias("d_"), F.array_join(name_parts(), "").alias("j_"))


query("compound_keys", f"WITH {_F} {_COMPOUND}")(lambda spark, d: parts(spark, d).select("k", F.explode(F.array_distinct(L.compound_keys(F.col("n_"), F.col("a_"), F.col("d_")))).alias("key")))
query("name_word_keys", f"WITH {_F} SELECT DISTINCT * FROM ({_NW})")(lambda spark, d: parts(spark, d).select("k", F.explode(F.array_distinct(L.name_word_keys(F.col("n_"), F.col("a_"), 3, sorted(set(T.STREET.values()))))).alias("key")))


def with_parts(b):
    return b.select("*", name_parts().alias("n_"), address_parts().alias("a_"), number_parts().alias("d_"))


def keys_of():
    """The distinct keys of a record of ``with_parts``."""
    skeletons = F.transform(F.filter("n_", lambda t: F.length(t) >= 3), T.skeleton)
    return L.record_keys(F.col("n_"), F.col("a_"), F.col("d_"), T.name_concat(F.col("n_")), skeletons)


def all_keys(b):
    return with_parts(b).select("k", "g", "v", "country", F.explode(keys_of()).alias("key"))


def _skeleton(t: str) -> str:
    out = t
    for old, new in (("ph", "f"), ("bh", "b"), ("dh", "d"), ("th", "t"), ("kh", "k"), ("gh", "g"), ("sh", "s"), ("ch", "c"), ("ck", "k"), ("q", "k"), ("c", "k"), ("w", "v"), ("z", "j"), ("x", "ks")):
        out = f"replace({out}, '{old}', '{new}')"
    out = f"(substr({out}, 1, 1) || regexp_replace(substr({out}, 2), '[aeiouyh]', '', 'g'))"
    for c in "bdfgjklmnprstv":
        out = f"regexp_replace({out}, '{c}{{2,}}', '{c}', 'g')"
    return out


_RK = f"""{_F}, rk AS (SELECT k, 'n:' || unnest(n) AS key FROM f UNION SELECT k, 'n:' || array_to_string(n, '') FROM f WHERE len(n) >= 2 UNION SELECT k, 'a:' || unnest(a) FROM f UNION SELECT k, 'd:' || unnest(d) FROM f UNION SELECT k, 'k:' || {_skeleton('t')} FROM (SELECT k, unnest(n) AS t FROM f) WHERE length(t) >= 3 UNION {_COMPOUND})"""
query("record_keys", f"WITH {_RK} SELECT k, key FROM rk")(lambda spark, d: all_keys(biz(spark, d)).select("k", "key"))
query("char_ngrams", f"WITH {_F} SELECT k, array_to_string(list_transform(range(1, greatest(length(s) - 1, 1)), lambda i: substr(s, i, 3)), ' ') AS grams FROM (SELECT k, array_to_string(n, '') AS s FROM f)")(lambda spark, d: parts(spark, d).select("k", words(T.char_ngrams(F.col("j_"), 3)).alias("grams")))
query("nearest_s1", f"""WITH {_RK}, e AS (SELECT rk.*, v FROM rk JOIN f USING (k)), s AS (SELECT key, count(*) AS df FROM e WHERE v = 0 GROUP BY key HAVING count(*) <= 300), x AS (SELECT a.k AS s1, b.k AS r, round(sum(ln((SELECT count(DISTINCT k) FROM e WHERE v = 0) / df)), 6) AS score FROM e a JOIN s USING (key) JOIN e b USING (key) WHERE a.v = 0 AND b.v > 0 GROUP BY ALL)
  SELECT s1, r, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, s1) AS k FROM x) WHERE k = 1""")(
    lambda spark, d: (lambda k: L.nearest_s1(k.where("v = 0").select(F.col("k").alias("eid"), "key"), k.where("v > 0").select(F.col("k").alias("eid"), "key")))(saved(all_keys(biz(spark, d)).select("k", "v", "key"))))
query("partition_by_country", f"WITH {_KEYS} SELECT eid, part FROM parts")(lambda spark, d: R.partition_by_country(records(spark, d)).select("eid", "part"))
_V2 = f"""{_TRIMMED}, n2 AS (SELECT 64 AS bit, s1, r, score FROM view UNION ALL SELECT 4, s1, r, round(score / 2, 6) FROM view WHERE rank_r = 0 UNION ALL SELECT 4, s1 + 2, r, 0.01 FROM view WHERE rank_s1 = 0)"""
query("merge_views", _V2 + " SELECT s1, r, CAST(bit_or(bit) AS BIGINT) AS views, max(score) AS score FROM n2 GROUP BY s1, r")(lambda spark, d: (lambda v: R.merge_views_of({64: [v], 4: [v.where("rank_r = 0").withColumn("score", F.round(F.col("score") / 2, 6)), v.where("rank_s1 = 0").withColumn("s1", F.col("s1") + 2).withColumn("score", F.lit(0.01))]}))(saved(R.search_view(*_sides(spark, d), seed_cap=SEEDS, verify=CHECKED))))
_AK = "CASE WHEN regexp_matches({0}, '^[0-9]') THEN regexp_extract({0}, '^[0-9]+') ELSE '' END"
_EXACT = f"WITH {_F}, x AS (SELECT k, v, country || '|' || array_to_string(list_sort(n), ' ') || '|' || coalesce(d[1], '') AS key FROM f)"


def exact(spark, d):
    return biz(spark, d).select(F.col("k").alias("eid"), "v", F.concat_ws("|", "country", words(F.array_sort(name_parts())), F.coalesce(F.get(number_parts(), 0), F.lit(""))).alias("key"))


query("exact_key_rescue", _EXACT + " SELECT s1, r, key FROM (SELECT key, any_value(k) AS s1 FROM x WHERE v = 0 GROUP BY key HAVING count(*) = 1) JOIN (SELECT key, any_value(k) AS r FROM x WHERE v > 0 GROUP BY key HAVING count(*) = 1) USING (key)")(lambda spark, d: (lambda e: R.exact_key_rescue(e.where("v = 0"), e.where("v > 0")))(exact(spark, d)))
query("capped_key_join", _EXACT + ", few AS (SELECT key FROM x WHERE v > 0 GROUP BY key HAVING count(*) <= 20) SELECT a.k AS s1, b.k AS r, a.key FROM x a JOIN few USING (key) JOIN x b USING (key) WHERE a.v = 0 AND b.v > 0")(lambda spark, d: (lambda e: R.capped_key_join(e.where("v = 0"), e.where("v > 0")))(exact(spark, d)))
_WORDS = f"{_B}, w AS (SELECT k AS eid, v, country, {_CONTENT.format('name')} AS words, {_AK.format('address')} AS address FROM biz)"


def named(spark, d):
    return biz(spark, d).select(F.col("k").alias("eid"), "v", "country", B.content_words(F.col("name")).alias("words"), F.regexp_extract("address", "^[0-9]+", 0).alias("address"))


def initials(t):
    return t.withColumn("words", F.when(F.col("v") == 1, F.array(F.array_join(F.transform("words", lambda w: F.substring(w, 1, 1)), ""))).otherwise(F.col("words")))


_INIT = _WORDS + ", i AS (SELECT eid, v, country, address, CASE WHEN v = 1 THEN [array_to_string(list_transform(words, lambda w: substr(w, 1, 1)), '')] ELSE words END AS words FROM w)"
query("acronym_join", f"WITH {_INIT}, m AS (SELECT DISTINCT a.eid AS s1, b.eid AS r FROM i a JOIN i b ON a.country = b.country AND a.address = b.address AND a.address <> '' AND len(b.words) = 1 AND array_to_string(list_transform(a.words, lambda w: substr(w, 1, 1)), '') = b.words[1] WHERE a.v = 0 AND b.v > 0 AND len(a.words) BETWEEN 2 AND 5 AND length(b.words[1]) BETWEEN 2 AND 5) SELECT s1, r FROM m WHERE r IN (SELECT r FROM m GROUP BY r HAVING count(*) = 1) AND r % 4 <> 0")(
    lambda spark, d: (lambda t: L.acronym_join(t.where("v = 0"), t.where("v > 0"), t.where("eid % 4 = 0").select(F.col("eid").alias("r"))))(initials(named(spark, d))))
_BRAND = _WORDS + ", i AS (SELECT eid, v, country, address, CASE WHEN v = 2 THEN ['zz' || array_to_string(words, '')] ELSE words END AS words FROM w)"
query("brand_join", f"WITH {_BRAND}, one AS (SELECT country, address, any_value(eid) AS s1 FROM i WHERE v = 0 AND address <> '' GROUP BY ALL HAVING count(*) = 1) SELECT s1, eid AS r FROM i JOIN one USING (country, address) WHERE v > 0 AND len(words) = 1 AND length(words[1]) BETWEEN 5 AND 15 AND words[1] NOT IN (SELECT unnest(words) FROM i e WHERE e.v = 0) AND eid % 4 <> 0")(
    lambda spark, d: (lambda t: L.brand_join(t.where("v = 0"), t.where("v > 0"), t.where("eid % 4 = 0").select(F.col("eid").alias("r"))))(named(spark, d).withColumn("words", F.when(F.col("v") == 2, F.array(F.concat(F.lit("zz"), F.array_join("words", "")))).otherwise(F.col("words")))))
query("closeness_bucket", f"WITH {_F}, p AS (SELECT a.k AS s1, b.k AS r, len(list_intersect(a.n, b.n)) / nullif(len(list_distinct(list_concat(a.n, b.n))), 0) AS x, len(list_intersect(a.a, b.a)) / nullif(len(list_distinct(list_concat(a.a, b.a))), 0) AS y FROM f a JOIN f b USING (g) WHERE a.v = 0 AND b.v > 0) SELECT s1, r, CASE WHEN coalesce(x, 0) >= 0.5 AND coalesce(y, 0) >= 0.5 THEN 'both' WHEN coalesce(x, 0) >= 0.5 THEN 'name' WHEN coalesce(y, 0) >= 0.5 THEN 'address' ELSE 'neither' END AS bucket FROM p")(
    lambda spark, d: (lambda b: b.where("v = 0").select("g", F.col("k").alias("s1"), name_parts().alias("n"), address_parts().alias("a")).join(b.where("v > 0").select("g", F.col("k").alias("r"), name_parts().alias("m"), address_parts().alias("b")), "g").select("s1", "r", L.closeness_bucket(P.jaccard(F.col("n"), F.col("m")), P.jaccard(F.col("a"), F.col("b"))).alias("bucket")))(biz(spark, d)))
_IDF = f"WITH {_F}, df AS (SELECT t, ln((SELECT count(*) FROM f) / count(*)) AS w FROM (SELECT DISTINCT k, unnest(n) AS t FROM f) GROUP BY t), e AS (SELECT DISTINCT k, t, w FROM (SELECT k, unnest(n) AS t FROM f) JOIN df USING (t)), p AS (SELECT a.k AS s1, b.k AS r FROM f a JOIN f b USING (g) WHERE a.v = 0 AND b.v > 0)"


def weighted(spark, d):
    own = biz(spark, d).select("k", "g", "v", F.array_distinct(name_parts()).alias("n"))
    t = own.select("k", F.explode("n").alias("token"))
    w = t.groupBy("token").agg(F.log(own.count() / F.count(F.lit(1))).alias("w"))
    return own, t.join(w, "token")


query("idf_cosine", _IDF + """, s AS (SELECT p.s1, p.r, coalesce((SELECT sum(x.w * x.w) FROM e x JOIN e y USING (t) WHERE x.k = p.s1 AND y.k = p.r), 0) AS bb2, coalesce((SELECT sum(x.w) FROM e x JOIN e y USING (t) WHERE x.k = p.s1 AND y.k = p.r), 0) AS bb, (SELECT count(*) FROM e x JOIN e y USING (t) WHERE x.k = p.s1 AND y.k = p.r) AS n,
    (SELECT sum(w * w) FROM e WHERE k = p.s1) AS a2, (SELECT sum(w * w) FROM e WHERE k = p.r) AS b2, (SELECT sum(w) FROM e WHERE k = p.s1) AS a, (SELECT sum(w) FROM e WHERE k = p.r) AS b, (SELECT count(*) FROM e WHERE k = p.s1) AS la, (SELECT count(*) FROM e WHERE k = p.r) AS lb FROM p)
  SELECT s1, r, round(bb2 / sqrt(a2 * b2), 6) AS idf_cosine, round(bb / (a + b - bb), 6) AS idf_overlap, CAST(n AS INTEGER) AS inter, round(n / la, 6) AS cont_s1, round(n / lb, 6) AS cont_r, round(b - bb, 6) + 0.0 AS extra_r, round(a - bb, 6) + 0.0 AS extra_s1 FROM s""")(
    lambda spark, d: (lambda own, w: P.weighted_sets(own.where("v = 0").select("g", F.col("k").alias("s1")).join(own.where("v > 0").select("g", F.col("k").alias("r")), "g").select("s1", "r"), w.withColumnRenamed("k", "eid")))(*weighted(spark, d)))
query("rule_city", f"WITH {_B}, {_TRUE}, c AS (SELECT k, {_CITIES.format('address')} AS c FROM biz) SELECT s1, r FROM true_pairs JOIN c a ON a.k = s1 JOIN c b ON b.k = r WHERE NOT (len(a.c) > 0 AND len(b.c) > 0 AND NOT list_has_any(a.c, b.c))")(
    lambda spark, d: (lambda c: true_pairs(spark, d).join(c.select(F.col("k").alias("s1"), F.col("c").alias("a")), "s1").join(c.select(F.col("k").alias("r"), F.col("c").alias("b")), "r").where(~B.city_mismatch(F.col("a"), F.col("b"))).select("s1", "r"))(biz(spark, d).select("k", B.city_components(F.col("address")).alias("c"))))
query("lo_summary", f"WITH {_ODDS} SELECT eid, min(odds) AS lo_min, round(sum(odds), 6) + 0.0 AS lo_sum, CAST(count(*) FILTER (odds < -1) AS INTEGER) AS lo_low FROM (SELECT DISTINCT eid, token FROM tok) JOIN odds USING (token) WHERE grp = -1 GROUP BY eid")(
    lambda spark, d: tokens(spark, d).select("eid", "token").distinct().join(odds(spark, d).where("grp = -1"), "token").groupBy("eid").agg(F.collect_list("odds").alias("o")).select("eid", *((F.round(c, 6) + F.lit(0.0) if n == "lo_sum" else c).alias(n) for n, c in L.odds_summary(F.col("o")).items())))
