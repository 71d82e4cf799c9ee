"""Text normalisation as column expressions: folding, tokens, address words and numbers, keys, skeletons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Word lists and patterns that results depend on.
LEGAL = "inc incorporated llc ltd limited pvt private corp corporation co company cos lp llp pllc pc plc gmbh sarl sas sasu eurl sa sci snc ei".split()
NAME_STOP = "the and of a an de du des la le les et www com net org dba aka shri sri smt dr mr mrs ms".split()
ADDR_STOP = "null none na no nos h hno house plot door flat unit apt apartment suite ste floor fl bldg building near nr opp opposite behind beside po box pmb nd th de du des la le les sur en au aux bis ter quater cedex".split()
STREET = {
    "road": "rd", "street": "st", "str": "st", "saint": "st", "avenue": "ave", "av": "ave", "boulevard": "blvd", "bd": "blvd", "lane": "ln", "drive": "dr", "place": "pl", "court": "ct", "circle": "cir",
    "highway": "hwy", "parkway": "pkwy", "square": "sq", "terrace": "ter", "trail": "trl", "rue": "rue", "chemin": "ch", "impasse": "imp", "allee": "all", "route": "rte", "faubourg": "fg",
}
UNITS = "first second third fourth fifth sixth seventh eighth ninth".split()
TEENS = "tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
PHONETIC = (("ph", "f"), ("bh", "b"), ("dh", "d"), ("th", "t"), ("kh", "k"), ("gh", "g"), ("sh", "s"), ("ch", "c"), ("ck", "k"), ("q", "k"), ("c", "k"), ("w", "v"), ("z", "j"), ("x", "ks"))
SKIPPED = ("rue r avenue ave av boulevard bd blvd impasse imp allee all chemin ch route rte place pl quai cours faubourg fg de du des la le les l d st saint no nr n nos bis ter quater street road rd lane ln "
           "drive dr the hno sno h plot flat door house shop ward block sector floor fl unit apt suite ste survey khasra gat gut").split()

DEPARTMENT_REGION = {
    "hauts de france": ("aisne", "nord", "oise", "pas de calais", "somme"),
    "nouvelle aquitaine": ("charente", "charente maritime", "correze", "creuse", "dordogne", "gironde", "landes", "lot et garonne", "pyrenees atlantiques", "deux sevres", "vienne", "haute vienne"),
    "pays de la loire": ("loire atlantique", "maine et loire", "mayenne", "sarthe", "vendee"),
}
NUMBER_AND_STREET = "(?:^|[^0-9])0*([0-9]+)[^a-z0-9]*([a-z]{2,})"


@F.pandas_udf(StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKD")


def decomposed(text: Column) -> Column:
    """NFKD without combining marks, by an Arrow UDF that gets the rows with letters outside ASCII only."""
    odd = text.rlike("[^\\x00-\\x7F]")
    return F.regexp_replace(F.coalesce(_decomposed(F.when(odd, text)), text), "[\\u0300-\\u036f]", "")


def fold(text: Column) -> Column:
    """Accents off, anything else outside ASCII to a space, lower case."""
    return F.lower(F.regexp_replace(decomposed(text), "[^\\x00-\\x7F]", " "))


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def dict_map_tokens(tokens: Column, table: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, t), t))


def tokens_of(folded: Column, pattern: str, stop: list[str], least: int) -> Column:
    words = _words(stop)
    return F.filter(F.split(folded, pattern), lambda t: (F.length(t) >= least) & ~F.array_contains(words, t))


def name_tokens(text: Column) -> Column:
    return tokens_of(fold(text), "[^a-z0-9]+", LEGAL + NAME_STOP, 2)


def ordinals_to_digits(folded: Column) -> Column:
    """Written ordinals of 1 to 39, compound ones first."""
    out = folded
    for tens, digit in (("twenty", 2), ("thirty", 3)):
        for k, unit in enumerate(UNITS):
            out = F.regexp_replace(out, f"\\b{tens}[ -]?{unit}\\b", str(10 * digit + k + 1))
    for k, word in enumerate(UNITS + TEENS):
        out = F.regexp_replace(out, f"\\b{word}\\b", str(k + 1))
    return F.regexp_replace(F.regexp_replace(out, "\\btwentieth\\b", "20"), "\\bthirtieth\\b", "30")


def address_text(text: Column) -> Column:
    """Folded, ordinals as digits, a French department that is a whole comma part as its region."""
    out = F.regexp_replace(ordinals_to_digits(fold(text)), "([0-9])(st|nd|rd|th)\\b", "$1")
    for region, departments in DEPARTMENT_REGION.items():
        names = "|".join(d.replace(" ", "[ -]+") for d in sorted(departments, key=len, reverse=True))
        out = F.regexp_replace(out, f"(^|,)\\s*(?:{names})\\s*(?=,|$)", f"$1 {region} ")
    return out


def address_words(text: Column) -> Column:
    """Letters only; a lone r is rue; markers dropped; street types shortened."""
    words = dict_map_tokens(F.split(address_text(text), "[^a-z]+"), {"r": "rue"})
    stop = _words(ADDR_STOP)
    return dict_map_tokens(F.filter(words, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t)), STREET)


def address_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(address_text(text), F.lit("([0-9]+)")), lambda t: F.regexp_replace(t, "^0+([0-9])", "$1"))


def name_concat(tokens: Column) -> Column:
    return F.when(F.size(tokens) >= 2, F.array_join(tokens, ""))


def name_key(country: Column, text: Column) -> Column:
    tokens = F.array_join(F.array_sort(F.array_distinct(name_tokens(text))), " ")
    return F.when(tokens == "", F.lit("")).otherwise(F.concat_ws("|", country, tokens))


def numstreet_key(text: Column) -> Column:
    plain = F.regexp_replace(address_text(text), "\\b(?:" + "|".join(SKIPPED) + ")\\b", " ")
    pattern = NUMBER_AND_STREET
    return F.when(plain.rlike(pattern), F.concat_ws("|", F.regexp_extract(plain, pattern, 1), F.regexp_extract(plain, pattern, 2))).otherwise("")


def skeleton(token: Column) -> Column:
    """Phonetic merges, then the first letter and the consonants that follow, runs collapsed."""
    out = token
    for old, new in PHONETIC:
        out = F.replace(out, F.lit(old), F.lit(new))
    rest = F.regexp_replace(F.substring(out, 2, 1_000_000), "[aeiouyh]", "")
    return F.regexp_replace(F.concat(F.substring(out, 1, 1), rest), "([bdfgjklmnprstv])\\1+", "$1")


def legal_forms(text: Column) -> Column:
    """Distinct legal forms among the words, sorted."""
    forms = _words(LEGAL)
    return F.array_sort(F.array_distinct(F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda t: F.array_contains(forms, t))))


def char_ngrams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))
