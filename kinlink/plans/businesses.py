"""Queries of names, addresses and their comparison, on business records made from the customer table.

Three customers with neighbouring keys make up one business: the first names it, the two others write it
with other legal forms, typos, numbers and places.  The records are made by the same plain SQL on both
sides; the operators' SQL shares no table with the code but the fixed word lists.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import businesses as B
from ..functions import indic as I
from ..functions import pairs as P
from ..functions import text as T
from .catalogue import _read
from .registry import query


def _pick(words: str, by: str) -> str:
    n = words.count("|") + 1
    return f"split_part('{words}', '|', CAST(1 + ({by}) % {n} AS INT))"


_G, _V = "CAST(floor(c_custkey / 3) AS BIGINT)", "c_custkey % 3"
_W1, _W2 = _pick("Golden|Silver|Apex|Lotus|Northern|Crown|Delta|Orion|Quiet|Rapid|Saffron", _G), _pick("Traders|Motors|Textiles|Bakery|Marketing|Software|Foods|Chemicals|Center|Services|Builders|Exports|Fabrics", f"CAST(floor({_G} / 5) AS BIGINT)")
_FORM = f"CASE {_V} WHEN 0 THEN {_pick('Private Limited|LLC|SARL|Inc', _G)} WHEN 1 THEN {_pick('Pvt Ltd|L.L.C.|S.A.R.L|', _G)} ELSE {_pick('|Incorporated|Corp|dba Shop.com', _G)} END"
_NAME = f"trim(CASE WHEN {_V} = 1 AND {_G} % 4 = 1 THEN 'Shri ' ELSE '' END || {_W1} || ' ' || CASE WHEN {_V} = 2 AND {_G} % 3 = 0 THEN replace({_W2}, 'e', 'é') ELSE {_W2} END || CASE WHEN {_V} = 1 AND {_G} % 6 = 2 THEN ' Groupe' ELSE '' END || ' ' || {_FORM})"
_NUMBER = f"CAST(100 + {_G} % 890 + CASE WHEN {_V} = 2 AND {_G} % 5 = 0 THEN 3 WHEN {_V} = 1 AND {_G} % 7 = 0 THEN -1 ELSE 0 END AS VARCHAR(9))"
_STREET = f"{_pick('Jean Moulin|Victor Hugo|Station|Lake View|Mill', _G)} || ' ' || CASE {_V} WHEN 0 THEN {_pick('Street|Avenue|Road|Boulevard', _G)} ELSE {_pick('St|Ave|Rd|Bd', _G)} END"
_ADDRESS = f"CASE WHEN {_V} = 2 AND {_G} % 11 = 0 THEN '' ELSE CASE WHEN {_G} % 6 = 0 THEN '00' ELSE '' END || {_NUMBER} || CASE WHEN {_G} % 9 = 0 THEN 'bis' ELSE '' END || ' ' || {_STREET} || ', ' || CASE WHEN {_V} = 1 THEN 'St Louis' ELSE 'Saint Louis' END || ', ' || {_pick('Nord|Texas|Pune|Sarthe|Deux Sèvres', _G)} || CASE WHEN {_G} % 13 = 0 THEN ', Twenty-First Floor near Park' ELSE '' END END"
BIZ = f"SELECT c_custkey AS k, {_G} AS g, {_V} AS v, CAST({_G} % 3 AS VARCHAR(4)) AS country, {_NAME} AS name, {_ADDRESS} AS address FROM customer"
_B = f"biz AS ({BIZ})"
_PAIRS = f"{_B}, pairs AS (SELECT a.k AS s1, b.k AS r, a.name AS na, b.name AS nb, a.address AS aa, b.address AS ab FROM biz a JOIN biz b USING (g) WHERE a.v = 0 AND b.v > 0)"
_FOLDED = "lower(regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', ' ', 'g'))"


def biz(spark, d):
    _read(spark, d, "customer").createOrReplaceTempView("kinlink_customer")
    return spark.sql(BIZ.replace("FROM customer", "FROM kinlink_customer"))


def pairs(spark, d):
    b = biz(spark, d)
    left, right = (b.where(w).select("g", F.col("k").alias(k), F.col("name").alias(n), F.col("address").alias(a)) for w, k, n, a in (("v = 0", "s1", "na", "aa"), ("v > 0", "r", "nb", "ab")))
    return left.join(right, "g").select("s1", "r", "na", "nb", "aa", "ab")


def words(c):
    return F.array_join(c, " ")


_STOP = "[" + ", ".join(f"'{w}'" for w in T.LEGAL + T.NAME_STOP) + "]"
_ADDR_STOP = "[" + ", ".join(f"'{w}'" for w in T.ADDR_STOP) + "]"
_STREETS = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in T.STREET.items()) + "}"
_ATEXT = f"""regexp_replace(regexp_replace(regexp_replace({_FOLDED.format('address')}, '\\btwenty[ -]?first\\b', '21', 'g'), '([0-9])(st|nd|rd|th)\\b', '\\1', 'g'), '(^|,)\\s*(?:nord)\\s*(,|$)', '\\1 hauts de france \\2', 'g')"""
_ATEXT = f"regexp_replace(regexp_replace({_ATEXT}, '(^|,)\\s*(?:sarthe)\\s*(,|$)', '\\1 pays de la loire \\2', 'g'), '(^|,)\\s*(?:deux[ -]+sevres)\\s*(,|$)', '\\1 nouvelle aquitaine \\2', 'g')"
_AWORDS = f"list_transform(list_filter(list_transform(string_split_regex({_ATEXT}, '[^a-z]+'), lambda t: CASE WHEN t = 'r' THEN 'rue' ELSE t END), lambda t: length(t) >= 2 AND NOT list_contains({_ADDR_STOP}, t)), lambda t: coalesce({_STREETS}[t], t))"


def one(name, sql, f):
    query(name, sql)(lambda spark, d: f(biz(spark, d)))


def two(name, sql, f):
    query(name, sql)(lambda spark, d: f(pairs(spark, d)))


one("address_text", f"WITH {_B} SELECT k, trim(regexp_replace({_ATEXT}, ' +', ' ', 'g')) AS text FROM biz", lambda b: b.select("k", F.trim(F.regexp_replace(T.address_text(F.col("address")), " +", " ")).alias("text")))
one("ordinals_to_digits", f"WITH {_B} SELECT k, regexp_replace({_FOLDED.format('address')}, '\\btwenty[ -]?first\\b', '21', 'g') AS text FROM biz", lambda b: b.select("k", T.ordinals_to_digits(T.fold(F.col("address"))).alias("text")))
one("address_words", f"WITH {_B} SELECT k, array_to_string({_AWORDS}, ' ') AS words FROM biz", lambda b: b.select("k", words(T.address_words(F.col("address"))).alias("words")))
one("address_numbers", f"WITH {_B} SELECT k, array_to_string(list_transform(regexp_extract_all({_ATEXT}, '[0-9]+'), lambda t: regexp_replace(t, '^0+([0-9])', '\\1')), ' ') AS numbers FROM biz", lambda b: b.select("k", words(T.address_numbers(F.col("address"))).alias("numbers")))
one("dict_map_tokens", f"WITH {_B} SELECT k, array_to_string(list_transform(string_split(lower(name), ' '), lambda t: CASE t WHEN 'golden' THEN 'gold' WHEN 'inc' THEN 'incorporated' ELSE t END), ' ') AS words FROM biz", lambda b: b.select("k", words(T.dict_map_tokens(F.split(F.lower(F.col("name")), " "), {"golden": "gold", "inc": "incorporated"})).alias("words")))
one("numstreet_key", f"""WITH {_B}, t AS (SELECT k, regexp_replace({_ATEXT}, '\\b(?:{'|'.join(T.SKIPPED)})\\b', ' ', 'g') AS t FROM biz) SELECT k, CASE WHEN regexp_matches(t, '{T.NUMBER_AND_STREET}') THEN regexp_extract(t, '{T.NUMBER_AND_STREET}', 1) || '|' || regexp_extract(t, '{T.NUMBER_AND_STREET}', 2) ELSE '' END AS key FROM t""", lambda b: b.select("k", T.numstreet_key(F.col("address")).alias("key")))
_TITLES = "['mr', 'mrs', 'ms', 'dr', 'shri', 'sri', 'smt', 'prof']"
_LEGAL_SQL = "|".join(sorted((f.replace(" ", "  ") for f in B.LEGAL_FORMS), key=lambda f: (-f.count("  "), -len(f), f)))
_CODES = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in B.LEGAL_FORMS.items()) + "}"
_PARSED = f"""p AS (SELECT k, name, array_to_string(w, ' ') AS n_full, ' ' || array_to_string(w, '  ') || ' ' AS s FROM (SELECT *, regexp_extract_all(regexp_replace(lower(strip_accents(name)), '[&+]', ' and ', 'g'), '[a-z0-9]+') AS w FROM biz)),
  q AS (SELECT *, list_filter(string_split_regex(trim(regexp_replace(s, ' ({_LEGAL_SQL}) ', '', 'g')), ' +'), lambda t: NOT list_contains(list_concat({_TITLES}, ['dba', 'formerly']), t) AND t <> '') AS kept, string_split_regex(trim(regexp_replace(s, ' ({_LEGAL_SQL}) ', '', 'g')), ' +') AS rest FROM p),
  z AS (SELECT k, n_full, CASE WHEN len(kept) = 0 THEN n_full ELSE array_to_string(kept, ' ') END AS n_core, coalesce({_CODES}[replace(regexp_extract(s, ' ({_LEGAL_SQL}) ', 1), '  ', ' ')], '') AS n_legal, list_has_any(rest, {_TITLES}) AS f_honorific, regexp_matches(name, '(?i)(^|\\W)[a-z0-9-]+\\.(com|in|net|org|co|fr|io)\\b') AS f_domain, regexp_matches(name, '(?i)\\bdba\\b') AS f_dba FROM q)"""
one("parse_name", f"WITH {_B}, {_PARSED} SELECT k, n_full, n_core, replace(n_core, ' ', '') AS n_concat, n_legal, f_domain, f_dba, f_honorific FROM z", lambda b: b.select("k", *(c.alias(n) for n, c in B.parse_name(F.col("name")).items() if n in ("n_full", "n_core", "n_concat", "n_legal", "f_domain", "f_dba", "f_honorific"))))
one("name_flags", f"WITH {_B} SELECT k, regexp_matches(name, '(?i)(^|\\W)[a-z0-9-]+\\.(com|in|net|org|co|fr|io)\\b') AS f_domain, regexp_matches(name, '(^|\\s)#\\w+') AS f_hashtag, regexp_matches(name, '[0-9]{{9}}') AS f_phone, regexp_matches(name, '(?i)\\bdba\\b') AS f_dba FROM biz", lambda b: b.select("k", *(c.alias(n) for n, c in B.name_flags(F.col("name")).items())))
one("addr_flags", f"""WITH {_B}, w AS (SELECT *, regexp_extract_all(lower(strip_accents(address)), '[a-z0-9]+') AS w FROM biz) SELECT k, false AS f_addr_null, false AS f_pobox, regexp_matches(address, '\\bnear\\b') AS f_landmark, false AS f_arrondissement, len(w) = 0 AS f_addr_empty, len(w) <= 3 AS f_addr_short, false AS f_fragment FROM w""", lambda b: b.select("k", *(c.alias(n) for n, c in B.addr_flags(F.col("address")).items())))
one("ascii_words", f"WITH {_B} SELECT k, array_to_string(regexp_extract_all(lower(strip_accents(name)), '[a-z0-9]+'), ' ') AS words FROM biz", lambda b: b.select("k", words(I.ascii_words(F.col("name"))).alias("words")))
_NWORDS = f"regexp_extract_all(regexp_replace(regexp_replace({_FOLDED.format('{}')}, '\\bs\\.a\\.r\\.l', 'sarl', 'g'), '\\bl\\.l\\.c', 'llc', 'g'), '[a-z0-9]+')"
_CONTENT = f"list_filter({_NWORDS}, lambda w: NOT list_contains({_STOP}, w))"
one("content_words", f"WITH {_B} SELECT k, array_to_string({_CONTENT.format('name')}, ' ') AS words FROM biz", lambda b: b.select("k", words(B.content_words(F.col("name"))).alias("words")))
one("abbr_name_key", f"WITH {_B} SELECT k, array_to_string(list_sort(list_transform({_CONTENT.format('name')}, lambda w: CASE w WHEN 'cie' THEN 'compagnie' WHEN 'ets' THEN 'etablissements' WHEN 'st' THEN 'saint' WHEN 'ste' THEN 'sainte' ELSE w END)), ' ') AS key FROM biz", lambda b: b.select("k", B.abbr_name_key(F.col("name")).alias("key")))
one("core_name_v2", f"WITH {_B} SELECT k, array_to_string(list_filter(string_split_regex(lower(regexp_replace(strip_accents(name), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains({_STOP}, w)), ' ') AS core FROM biz", lambda b: b.select("k", B.core_name_v2(F.col("name")).alias("core")))
_CITIES = f"list_filter(list_transform(list_filter(string_split({_FOLDED.format('{}')}, ','), lambda c: NOT regexp_matches(c, '[0-9]')), lambda c: regexp_replace(trim(regexp_replace(c, '[^a-z0-9]+', ' ', 'g')), '^st ', 'saint ')), lambda c: c <> '')"
one("city_components", f"WITH {_B} SELECT k, array_to_string({_CITIES.format('address')}, '|') AS places FROM biz", lambda b: b.select("k", F.array_join(B.city_components(F.col("address")), "|").alias("places")))
_BITS = "CAST(" + " | ".join(f"(CASE WHEN list_has_any(w, [{', '.join(repr(x) for x in ws)}]) THEN {1 << k} ELSE 0 END)" for k, ws in ((0, ["pvt", "private"]), (1, ["ltd", "limited"]), (2, ["llc"]), (3, ["inc", "incorporated"]), (4, ["corp"]), (13, ["sarl"]))) + " AS BIGINT)"
_LB = "lb AS (SELECT {}, string_split_regex(replace(" + _FOLDED + ", '.', ''), '[^a-z0-9]+') AS w FROM {})"
one("legal_bits", f"WITH {_B}, {_LB.format('k', 'name', 'biz')} SELECT k, {_BITS} AS bits FROM lb", lambda b: b.select("k", B.legal_bits(F.col("name")).alias("bits")))

# scripts; what is written how is spelt out by hand
SCRIPT = [("राम", "raam", "raama"), ("गोल्डन", "goldan", "goldana"), ("मार्केटिंग", "maarketing", "maarketimga"), ("दिल्ली", "dillii", "dillee"), ("लिमिटेड", "limited", "limiteda"), ("plain", "plain", "plain"), ("राम 12", "raam 12", "raama 12")]


def _script(column: int) -> str:
    return f"CASE c_custkey % {len(SCRIPT)} " + " ".join(f"WHEN {k} THEN '{row[column]}'" for k, row in enumerate(SCRIPT)) + " END"


for _name, _f, _column in (("translit_block", I.translit_block, 1), ("translit_norm", I.translit_norm, 2)):
    query(_name, f"SELECT c_custkey AS k, {_script(_column)} AS latin FROM customer")(lambda spark, d, _f=_f: _read(spark, d, "customer").select(F.col("c_custkey").alias("k"), _f(F.expr(_script(0))).alias("latin")))
query("has_indic", f"SELECT c_custkey AS k, c_custkey % {len(SCRIPT)} <> 5 AS indic FROM customer")(lambda spark, d: _read(spark, d, "customer").select(F.col("c_custkey").alias("k"), I.has_indic(F.expr(_script(0))).alias("indic")))
query("indic_name_tokens", f"SELECT c_custkey AS k, CASE c_custkey % {len(SCRIPT)} " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(("raam", "golden", "maarketing", "dillii", "", "plain", "raam 12"))) + " END AS tokens FROM customer")(
    lambda spark, d: _read(spark, d, "customer").select(F.col("c_custkey").alias("k"), words(I.indic_name_tokens(F.expr(_script(0)), {"goldan": "golden"})).alias("tokens")))

# pairs

_LA, _LBB = (f"string_split_regex(replace({_FOLDED.format(c)}, '.', ''), '[^a-z0-9]+')" for c in ("na", "nb"))
_REL = f"WITH {_PAIRS}, x AS (SELECT s1, r, {_BITS.replace('w,', _LA + ',')} AS a, {_BITS.replace('w,', _LBB + ',')} AS b FROM pairs)"
two("legal_relation", _REL + " SELECT s1, r, CASE WHEN a = 0 AND b = 0 THEN 'none' WHEN a = b THEN 'same' WHEN b = 0 THEN 'dropped' WHEN a = 0 THEN 'added' WHEN a & b = b THEN 'subset' WHEN a & b = a THEN 'superset' ELSE 'changed' END AS relation, bit_count(a & b) AS both FROM x",
    lambda p: p.select("s1", "r", B.legal_bit_relation(B.legal_bits(F.col("na")), B.legal_bits(F.col("nb"))).alias("relation"), F.bit_count(B.legal_bits(F.col("na")).bitwiseAND(B.legal_bits(F.col("nb")))).alias("both")))
_CODE = f"WITH {_PAIRS}, s AS (SELECT s1, r, regexp_extract(' ' || array_to_string(regexp_extract_all(lower(strip_accents(na)), '[a-z0-9]+'), '  ') || ' ', ' ({_LEGAL_SQL}) ', 1) AS a, regexp_extract(' ' || array_to_string(regexp_extract_all(lower(strip_accents(nb)), '[a-z0-9]+'), '  ') || ' ', ' ({_LEGAL_SQL}) ', 1) AS b FROM pairs), c AS (SELECT s1, r, coalesce({_CODES}[replace(a, '  ', ' ')], '') AS a, coalesce({_CODES}[replace(b, '  ', ' ')], '') AS b FROM s)"
two("legal_relation_v0", _CODE + " SELECT s1, r, CASE WHEN a = '' OR b = '' THEN 'missing' WHEN a = b THEN 'equal' WHEN (a IN ('inc', 'corp') AND b IN ('inc', 'corp')) OR (a IN ('ltd', 'pvt_ltd') AND b IN ('ltd', 'pvt_ltd')) THEN 'compatible' ELSE 'conflict' END AS relation FROM c",
    lambda p: p.select("s1", "r", B.legal_relation_v0(B.parse_name(F.col("na"))["n_legal"], B.parse_name(F.col("nb"))["n_legal"]).alias("relation")))
_LW = "list_sort(list_filter(" + _NWORDS + ", lambda w: list_contains([" + ", ".join(f"'{w}'" for w in T.LEGAL) + "], w)))"
two("legal_list_relation", f"WITH {_PAIRS}, x AS (SELECT s1, r, {_LW.format('na')} AS a, {_LW.format('nb')} AS b FROM pairs) SELECT s1, r, CASE WHEN a = b THEN 'eq' WHEN len(b) = 0 THEN 'r_none' WHEN len(a) = 0 THEN 's_none' ELSE 'changed' END AS relation FROM x", lambda p: p.select("s1", "r", B.legal_list_relation(F.col("na"), F.col("nb")).alias("relation")))
two("city_mismatch", f"WITH {_PAIRS}, x AS (SELECT s1, r, {_CITIES.format('aa')} AS a, {_CITIES.format('ab')} AS b FROM pairs) SELECT s1, r, len(a) > 0 AND len(b) > 0 AND NOT list_has_any(a, b) AS mismatch FROM x", lambda p: p.select("s1", "r", B.city_mismatch(B.city_components(F.col("aa")), B.city_components(F.col("ab"))).alias("mismatch")))
_NUMS = "list_distinct(list_transform(regexp_extract_all({}, '[0-9]+'), lambda x: CAST(x AS BIGINT)))"
_NS = f"WITH {_PAIRS}, x AS (SELECT s1, r, {_NUMS.format('aa')} AS a, {_NUMS.format('ab')} AS b FROM pairs)"
_nums = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("long")))
two("number_sets", _NS + " SELECT s1, r, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard, CAST(len(a) - len(list_intersect(a, b)) AS INTEGER) AS s1_only, CAST(len(b) - len(list_intersect(a, b)) AS INTEGER) AS r_only, CASE WHEN len(b) > 0 THEN len(list_filter(b, lambda y: len(list_filter(a, lambda x: abs(x - y) <= 10)) = 0)) = 0 END AS compatible FROM x",
    lambda p: p.select("s1", "r", F.round(P.jaccard(_nums(F.col("aa")), _nums(F.col("ab"))), 6).alias("jaccard"), F.size(F.array_except(_nums(F.col("aa")), _nums(F.col("ab")))).alias("s1_only"), F.size(F.array_except(_nums(F.col("ab")), _nums(F.col("aa")))).alias("r_only"), P.numbers_compatible(_nums(F.col("aa")), _nums(F.col("ab"))).alias("compatible")))
_RELC = "CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0 WHEN {a} = {b} THEN 1 WHEN least({a}, {b}) > 0 AND (greatest({a}, {b}) // 10 = least({a}, {b}) OR greatest({a}, {b}) // 100 = least({a}, {b}) OR greatest({a}, {b}) // 1000 = least({a}, {b})) THEN 2 WHEN abs({a} - {b}) <= 10 THEN 3 ELSE 4 END"
two("number_rel_code", _NS + f" SELECT s1, r, {_RELC.format(a='a[1]', b='b[1]')} AS code FROM x", lambda p: p.select("s1", "r", P.number_rel_code(F.get(_nums(F.col("aa")), 0), F.get(_nums(F.col("ab")), 0)).alias("code")))
two("number_best_rel", _NS + f" SELECT s1, r, list_min(list_transform(b, lambda y: {_RELC.format(a='a[1]', b='y')})) AS best, list_contains(b, a[1]) AS s1_in_r, list_contains(a, b[1]) AS r_in_s1 FROM x",
    lambda p: p.select("s1", "r", F.array_min(F.transform(_nums(F.col("ab")), lambda y: P.number_rel_code(F.get(_nums(F.col("aa")), 0), y))).alias("best"), F.array_contains(_nums(F.col("ab")), F.get(_nums(F.col("aa")), 0)).alias("s1_in_r"), F.when(F.size(_nums(F.col("ab"))) > 0, F.array_contains(_nums(F.col("aa")), F.get(_nums(F.col("ab")), 0))).alias("r_in_s1")))
two("number_edit", _NS + """, y AS (SELECT s1, r, a[1] AS m, b[1] AS n, CAST(a[1] AS VARCHAR) AS a, CAST(b[1] AS VARCHAR) AS b FROM x) SELECT s1, r, CASE WHEN m = n OR n - m IN (1, 2, 3, 4, 5, 7, 9, 11, 13, 21) THEN '' WHEN n - m IN (-1, -2) THEN 'minus' WHEN length(a) = length(b) THEN CASE WHEN levenshtein(a, b) = 1 THEN 'sub' WHEN damerau_levenshtein(a, b) = 1 THEN 'swap' ELSE '' END WHEN levenshtein(a, b) = 1 THEN 'indel' ELSE '' END AS edit FROM y WHERE b IS NOT NULL""",
    lambda p: p.select("s1", "r", F.get(_nums(F.col("aa")), 0).cast("string").alias("x"), F.get(_nums(F.col("ab")), 0).cast("string").alias("y")).where("y IS NOT NULL").select("s1", "r", B.number_edit(F.col("x"), F.col("y")).alias("edit")))
two("first_last_equal", f"WITH {_PAIRS}, x AS (SELECT s1, r, string_split(na, ' ') AS a, string_split(nb, ' ') AS b FROM pairs) SELECT s1, r, a[1] = b[1] AS first_equal, a[-1] = b[-1] AS last_equal, CAST(abs(len(a) - len(b)) AS INTEGER) AS count_diff FROM x",
    lambda p: p.select("s1", "r", *(c.alias(n) for n, c in P.first_last(F.col("na"), F.col("nb")).items())))
two("sim_osa", f"WITH {_PAIRS} SELECT s1, r, CAST(damerau_levenshtein(lower(strip_accents(na)), lower(strip_accents(nb))) AS BIGINT) AS d FROM pairs", lambda p: p.select("s1", "r", P.sim_osa(T.fold(F.col("na")), T.fold(F.col("nb"))).alias("d")))
two("sim_char3_cosine", f"""WITH {_PAIRS}, g AS (SELECT s1, r, 1 AS side, unnest(list_transform(range(1, length(aa) - 1), lambda i: substr(aa, i, 3))) AS g FROM pairs UNION ALL SELECT s1, r, 2, unnest(list_transform(range(1, length(ab) - 1), lambda i: substr(ab, i, 3))) FROM pairs),
  c AS (SELECT s1, r, side, g, count(*) AS n FROM g GROUP BY ALL), d AS (SELECT x.s1, x.r, sum(x.n * y.n) AS dot FROM c x JOIN c y ON x.s1 = y.s1 AND x.r = y.r AND x.g = y.g AND x.side = 1 AND y.side = 2 GROUP BY ALL), m AS (SELECT s1, r, side, sqrt(sum(n * n)) AS m FROM c GROUP BY ALL)
  SELECT p.s1, p.r, round(coalesce(dot / (a.m * b.m), 0), 6) AS cosine FROM pairs p LEFT JOIN d USING (s1, r) LEFT JOIN m a ON a.s1 = p.s1 AND a.r = p.r AND a.side = 1 LEFT JOIN m b ON b.s1 = p.s1 AND b.r = p.r AND b.side = 2""", lambda p: p.select("s1", "r", F.round(P.char_cosine(F.col("aa"), F.col("ab")), 6).alias("cosine")))
query("addr_parts")(lambda spark, d: biz(spark, d).select("k", B.addr_parts(F.col("address")).alias("p")).select("k", "p.number", words(F.col("p.words")).alias("street")))
query("same_address")(lambda spark, d: pairs(spark, d).select("s1", "r", B.same_address(B.addr_parts(F.col("aa")), B.addr_parts(F.col("ab"))).alias("f")).select("s1", "r", "f.*"))
query("sim_indel_norm")(lambda spark, d: pairs(spark, d).select("s1", "r", F.round(P.sim_ratio(T.fold(F.col("na")), T.fold(F.col("nb"))), 6).alias("similarity")))
query("sim_token_set")(lambda spark, d: pairs(spark, d).select("s1", "r", F.round(P.sim_token_set(T.fold(F.col("na")), T.fold(F.col("nb"))), 6).alias("token_set"), F.round(P.sim_partial(T.fold(F.col("na")), T.fold(F.col("nb"))), 6).alias("partial")))
query("name_edit")(lambda spark, d: pairs(spark, d).select("s1", "r", P.name_edit(words(B.name_words(F.col("na"))), words(B.name_words(F.col("nb")))).alias("e")).select("s1", "r", "e.*"))
