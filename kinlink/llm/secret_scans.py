"""Secret scanning with a random forest that removes false positives. DataFrame functions only.

Candidates are assignments to words such as ``password`` or ``token`` (also as quoted names, also within a
longer name, with or without a digit; a quoted value is taken whole), runs of 16 or more key-like
characters with a digit, and private keys between their BEGIN and END lines (or the BEGIN line alone).
A forest (Spark ML) scores each from its length, character classes and transitions between them, the
share that dictionary words cover, the path (``source``) and the words before it.  The dictionary is
learnt: letter runs that occur in at least one of ``RARE`` documents (and five), over all documents, and a
few words that placeholders are made of.

The forest learns from labelled findings (candidate, before, path, label).  No table holds any, so
``labelled_findings`` makes them: keys, tokens and passwords of known forms as secrets; numbers, hashes,
identifiers, paths and placeholders as none.  Pass own findings to replace them.

A finding is one distinct candidate of a document: its first place, how often it occurs, its score.

Defined results.  Null and empty texts have no finding; nor do documents without a candidate, which
have no row.  A null source is an empty path.  Rows without doc_id are left out.  Rows that repeat
doc_id and text give one finding each candidate, and count each.  An empty table gives an empty table;
very long texts are searched whole.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import NARROW, documents, stored

NAMES = "(?i:password|passwd|pwd|secret|token|api_?key|auth)"
SIGN = "[\"']?\\s?[=:]\\s?"
ASSIGNED = NAMES + SIGN + "(?:\"[^\"\\n]{6,}(?=\")|'[^'\\n]{6,}(?=')|[\"']?[^\\s\"']{6,})"
#: A whole run with a digit and without an assignment in it.
KEY_LIKE = "(?<![A-Za-z0-9+/_=\\-])(?=[A-Za-z+/_=\\-]*[0-9])(?![A-Za-z0-9+/_=\\-]*" + NAMES + SIGN + ")[A-Za-z0-9+/_=\\-]{16,}"
PEM = "-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\\s:,.\\-]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?"
#: A word of the dictionary is in one of so many documents at least.
RARE = 5000
CONTEXT = 32
TREES = 40
DEPTH = 7
WORDS = ("password", "secret", "token", "example", "sample", "dummy", "default", "change", "test", "user", "name", "value", "your", "this", "that", "with", "from", "have", "there", "their", "would", "about", "which", "other", "number", "people", "data", "file", "text", "http", "www", "com", "org", "the", "and", "ion", "ing", "ent", "ver", "ter", "con", "pro")
FEATURES = ("length", "digits", "uppers", "lowers", "marks", "transitions", "variety", "hexadecimal", "covered", "known_form", "assigned", "near_secret", "near_other", "doubtful_path")


def _share(c: Column, kept: str) -> Column:
    """Share of the characters of ``c`` in the class ``kept``."""
    return F.length(F.regexp_replace(c, f"[^{kept}]", "")) / F.greatest(F.length(c), F.lit(1))


def dictionary(docs: DataFrame) -> DataFrame:
    """word: letter runs of 3 to 16 letters that are common over all documents, and the placeholder words."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w).between(3, 16)))
    least = max(5, -(-docs.count() // RARE))
    common = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("word")
    fixed = docs.sparkSession.createDataFrame([(w,) for w in WORDS], "word string")
    return common.unionByName(fixed).distinct()


START = "^(?i:[a-z_\\-]*" + NAMES + "[a-z_\\-]*)" + SIGN + "[\"']?"


def covered(findings: DataFrame, words: DataFrame, files: int | None = None) -> DataFrame:
    """``findings`` with the share of each candidate's value that its letter runs (split where case rises) in the dictionary cover."""
    value = F.regexp_replace("candidate", START, "")
    runs = F.split(F.lower(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
    parts = findings.select("candidate").distinct().select("candidate", F.greatest(F.length(value), F.lit(1)).alias("n"), F.explode(runs).alias("word"))
    share = parts.join(words, "word").groupBy("candidate").agg((F.sum(F.length("word")) / F.first("n")).alias("covered"))
    return findings.join(stored(share, files), "candidate", "left").na.fill(0.0, ["covered"])


def features(findings: DataFrame) -> DataFrame:
    """``findings`` (candidate, before, path, covered) with the forest's columns."""
    start = START
    value = F.regexp_replace("candidate", start, "")
    near = F.lower(F.concat_ws(" ", "before", F.regexp_extract("candidate", start, 0)))
    form = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "0"), "[A-Z]+", "A"), "[a-z]+", "a")
    n = F.greatest(F.length(value), F.lit(1))
    columns = {
        "length": F.length(value), "digits": _share(value, "0-9"), "uppers": _share(value, "A-Z"), "lowers": _share(value, "a-z"), "marks": _share(value, "+/_=\\-"),
        "transitions": (F.length(form) - 1) / n, "variety": F.size(F.array_distinct(F.split(value, ""))) / n, "hexadecimal": value.rlike("^[0-9a-f]+$"),
        "known_form": value.rlike("^(AKIA|ASIA|ghp_|gho_|xox[bp]-|sk_live_|AIza|eyJ|-----BEGIN)"),
        "assigned": F.col("candidate").rlike(start), "near_secret": near.rlike("(^|[^a-z])(password|passwd|pwd|secret|token|api_?key|auth|bearer|credentials?)([^a-z]|$)"),
        "near_other": near.rlike("(^|[^a-z])(commit|sha|sha1|sha256|hash|digest|uuid|isbn|card|phone|example|checksum|etag)([^a-z]|$)"), "doubtful_path": F.lower("path").rlike("test|example|sample|fixture|readme|doc"),
    }
    return findings.select("*", *(c.cast("double").alias(k) for k, c in columns.items()))


def labelled_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """candidate, before, path, label: findings of known kinds, made from a counter by digests."""
    base = spark.range(0, rows, 1, 4).select("id", F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 512).alias("h"))
    upper = F.upper(F.translate(F.substring("h", 1, 16), "0123456789", "GHKMPQ2357"))
    mixed = F.translate(F.base64(F.unhex(F.substring("h", 1, 60))), "+/=", "xyz")
    digits = F.substring(F.concat_ws("", F.regexp_replace("h", "[a-f]", "")), 1, 16)
    words = F.concat_ws("_", *(F.get(F.array(*map(F.lit, WORDS)), F.pmod(F.xxhash64("h", F.lit(k)), F.lit(len(WORDS))).cast("int")) for k in range(4)), F.pmod("id", F.lit(100)).cast("string"))
    low = lambda a, n: F.substring("h", a, n)
    lowers = F.translate(F.substring("h", 40, 24), "0123456789", "ghkmpqrtwz")
    letters = F.translate(F.substring("h", 20, 14), "0123456789", "GhKmPqRTwz")
    kinds = [  # (candidate, words before, label)
        (F.concat(F.lit("AKIA"), upper), "", 1), (F.concat(F.lit("AKIA"), upper), "key id ", 1), (F.concat(F.lit("password="), low(1, 18)), "", 1), (F.concat(F.lit("passwd: "), mixed), "", 1),
        (low(1, 40), "token = \"", 1), (mixed, "api_key = ", 1), (F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), "", 1), (F.concat(F.lit("secret="), low(1, 32)), "config ", 1), (F.concat(F.lit("token = \""), low(1, 40)), "", 1),
        (F.concat(F.lit("password="), letters), "", 1), (F.concat(F.lit("pwd: "), letters, F.lit("!")), "login ", 1), (F.concat(F.lit("password="), F.substring(lowers, 1, 12)), "", 1), (F.concat(F.lit("token: "), lowers), "", 1), (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), mixed, F.lit("\n"), mixed, F.lit("\n-----END RSA PRIVATE KEY-----")), "", 1), (F.lit("-----BEGIN PRIVATE KEY-----"), "", 1),
        (F.concat(F.lit("password: "), F.translate(words, "_0123456789", "   ")), "", 0), (F.concat(F.lit("secret="), F.element_at(F.split(words, "_"), 1), F.lit("_"), F.element_at(F.split(words, "_"), 2)), "", 0),
        (digits, "", 0), (digits, "card ", 0), (low(1, 40), "commit ", 0), (low(1, 64), "sha256 ", 0), (F.concat_ws("-", low(1, 8), low(9, 4), low(13, 4), low(17, 4), low(21, 12)), "uuid ", 0),
        (words, "", 0), (F.concat(F.lit("password="), F.lit("your_password_here"), F.pmod("id", F.lit(10)).cast("string")), "", 0), (F.concat(F.lit("token: "), words), "", 0), (F.concat_ws("/", F.lit("www"), words, low(1, 6)), "", 0),
        (F.concat(F.lit("AKIA"), F.lit("EXAMPLEEXAMPLE"), F.pmod("id", F.lit(90)).cast("string")), "example ", 0), (F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 4), F.substring(digits, 9, 8)), "phone ", 0),
    ]
    pick = F.pmod("id", F.lit(len(kinds))).cast("int")
    choose = lambda k: F.get(F.array(*((F.lit(x[k]) if not isinstance(x[k], Column) else x[k]) for x in kinds)), pick)
    return base.select(choose(0).alias("candidate"), choose(1).alias("before"), F.when(F.pmod("id", F.lit(7)) == 0, F.lit("docs/readme")).otherwise(F.lit("src")).alias("path"), choose(2).cast("double").alias("label"))


def fit(findings: DataFrame) -> RandomForestClassificationModel:
    """``findings``: candidate, before, path, covered, label."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(features(findings)).select("x", "label")
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=17).fit(rows)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, candidate, path, start (code points, from 0), before, times; one row per distinct candidate of a document."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"))
    found = rows.withColumn("found", F.regexp_extract_all("text", F.lit(f"{PEM}|{ASSIGNED}|{KEY_LIKE}"), F.lit(0))).where(F.size("found") > 0)
    # places and contexts are taken before the texts are left behind
    placed = F.expr(f"""transform(transform(found, c -> struct(c AS candidate, instr(text, c) AS place)),
        x -> struct(x.candidate AS candidate, x.place - 1 AS start, substring(text, greatest(1, x.place - {CONTEXT}), least({CONTEXT}, x.place - 1)) AS before))""")
    one = found.select("doc_id", "path", F.explode(placed).alias("x")).select("doc_id", "path", "x.*")
    best = one.groupBy("doc_id", "candidate").agg(F.min(F.struct("start", "before", "path")).alias("x"), F.count(F.lit(1)).alias("times"))
    return best.select("doc_id", "candidate", "x.path", F.col("x.start").cast("long").alias("start"), "x.before", "times")


def secret_scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Findings with score (0 to 1, higher: likelier a secret) and predicted."""
    files = 1 + docs.count() // NARROW
    words = stored(dictionary(docs.where(F.col("doc_id").isNotNull()).select("text")), files)
    model = fit(covered(labelled_findings(docs.sparkSession) if findings is None else findings, words, 1))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(features(covered(stored(candidates(docs), files), words, files)))
    score = vector_to_array(F.col("probability"))[1]
    return model.transform(rows).select("doc_id", "start", F.length("candidate").cast("long").alias("length"), "times", "candidate", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir)).withColumn("candidate_sha256", F.sha2("candidate", 256)).drop("candidate")
