"""Parts of an address: state, city, street, numbers. One Arrow UDF; its helpers take plain strings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .businesses import NULL, addr_flags, parse_name
from .indic import ascii_words, plain_words

# Street types, regions and markers.
TYPES = {
    "street": "st", "str": "st", "st": "st", "saint": "st", "avenue": "ave", "av": "ave", "ave": "ave", "road": "rd", "rd": "rd", "drive": "dr", "dr": "dr", "lane": "ln", "ln": "ln", "boulevard": "blvd", "blvd": "blvd", "bd": "blvd",
    "court": "ct", "ct": "ct", "place": "pl", "pl": "pl", "trail": "trl", "trl": "trl", "marg": "marg", "nagar": "nagar", "colony": "colony", "sector": "sector", "rue": "rue", "r": "rue", "chemin": "ch", "ch": "ch",
    "impasse": "imp", "imp": "imp", "allee": "allee", "quai": "quai", "route": "rte", "rte": "rte", "faubourg": "fg", "fg": "fg",
}
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il",
    "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt",
    "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa",
    "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
    "district of columbia": "dc",
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "goa": "ga", "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl",
    "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn",
    "telangana": "ts", "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk", "west bengal": "wb", "delhi": "dl", "chandigarh": "ch", "puducherry": "py", "jammu and kashmir": "jk", "ladakh": "la",
    "ile de france": "idf", "hauts de france": "hdf", "normandie": "nor", "bretagne": "bre", "pays de la loire": "pdl", "centre val de loire": "cvl", "bourgogne franche comte": "bfc", "grand est": "ges", "nouvelle aquitaine": "naq",
    "occitanie": "occ", "auvergne rhone alpes": "ara", "provence alpes cote d azur": "paca", "corse": "cor",
}
MARKERS = set("h n no door plot flat site sf sy unit apt apartment suite ste pmb box cedex bis ter".split())
ORDINALS = {w: str(k + 1) for k, w in enumerate("first second third fourth fifth sixth seventh eighth ninth tenth".split())}
UNIT = re.compile("\\b(?:flat|unit|apt|apartment|suite|ste|room|rm)\\s*(?:no\\s*)?(\\d+)\\b")
UNIT_PART = re.compile("(?i)\\b(?:unit|apt|apartment|suite|ste|flat)\\s*(?:no\\s*)?[a-z0-9]+\\b")
SUFFIX = re.compile("(?<!\\d)(\\d+)\\s*(bis|ter|[a-z])\\b")
_CODES = set(STATES.values())


def state_of(part: str) -> str:
    """The region that a comma part ends with: the longest known name, else a code as its last word; numbers are passed over."""
    words = [w for w in plain_words(part) if not w.isdigit()]
    tails = (" ".join(words[k:]) for k in range(max(0, len(words) - 5), len(words)))
    named = next((STATES[t] for t in tails if t in STATES), None)
    return named or (words[-1] if words and words[-1] in _CODES else "")


def city_score(part: str) -> int:
    """How much a comma part looks like a city: short is good; digits, street types and markers are not."""
    words = plain_words(part)
    if not words:
        return -100
    faults = (4, any(c.isdigit() for w in words for c in w)), (3, any(w in TYPES and w not in ("saint", "st") for w in words)), (3, any(w in MARKERS for w in words))
    return 1 + 2 * (len(words) <= 4) - sum(n for n, there in faults if there)


def _short(word: str) -> str:
    if match := re.fullmatch("(\\d+)(?:st|nd|rd|th)", word):
        word = match[1]
    word = ORDINALS.get(word, word)
    return TYPES.get(word, word)


def parts_of(raw: str) -> tuple:
    """norm, street, city, state, first number, its suffix, all numbers, unit."""
    clean = re.sub(NULL, " ", raw)
    parts = [p.strip() for p in clean.split(",") if p.strip()]
    states = [state_of(p) for p in parts]
    at = max((k for k, s in enumerate(states) if s), default=-1)
    # the best-looking part is the city: near the state if there is one, else as late as possible
    rest = [(city_score(p), -abs(k - at) if at >= 0 else k, -k, k) for k, p in enumerate(parts) if k != at]
    best = max(rest, default=(-1, 0, 0, -1))
    city = best[3] if best[0] >= 0 else -1
    street = " ".join(plain_words(UNIT_PART.sub(" ", ", ".join(p for k, p in enumerate(parts) if k not in (at, city)))))
    every = plain_words(clean)
    text = " ".join(every)
    numbers = [int(n) for n in re.findall("\\d+", text)]
    own = re.search("\\d+", street)
    first = int(own[0]) if own else numbers[0] if numbers else None
    suffix = SUFFIX.search(street)
    unit = UNIT.search(text)
    kept = [w for w in street.split() if w not in MARKERS and (re.fullmatch("\\d+(?:st|nd|rd|th)", w) or not re.search("\\d", w))]
    return (" ".join(_short(w) for w in every if w != "cedex"), " ".join(map(_short, kept)), " ".join(TYPES.get(w, w) for w in plain_words(parts[city])) if city >= 0 else "", states[at] if at >= 0 else "", first,
            suffix[2] if suffix and first is not None and int(suffix[1]) == first else "", numbers, int(unit[1]) if unit else None)


_FIELDS = StructType([StructField("a_norm", StringType()), StructField("a_street", StringType()), StructField("a_city", StringType()), StructField("a_state", StringType()), StructField("a_num1", LongType()), StructField("a_num1_sfx", StringType()), StructField("a_nums", ArrayType(LongType())), StructField("a_unit", LongType())])


@F.pandas_udf(_FIELDS)
def parse_address(s: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([parts_of(x or "") for x in s], columns=_FIELDS.names)
    return out.astype({"a_num1": "Int64", "a_unit": "Int64"})


@F.pandas_udf(StringType())
def state_lookup(s: pd.Series) -> pd.Series:
    return s.map(lambda x: state_of(x or ""))


@F.pandas_udf(LongType())
def city_scores(s: pd.Series) -> pd.Series:
    return s.map(lambda x: city_score(x or ""))


def normalised(records, name: Column | None = None, address: Column | None = None):
    """eid, source, country and the 26 parsed columns of every record (eid, source, country, name, address)."""
    name, address = F.col("name") if name is None else name, F.col("address") if address is None else address
    rows = records.select("eid", "source", F.coalesce("country", F.lit("")).alias("country"), *(c.alias(n) for n, c in parse_name(name).items()), *(c.alias(n) for n, c in addr_flags(address).items()), F.size(F.filter(ascii_words(F.regexp_replace(F.coalesce(address, F.lit("")), NULL, " ")), lambda w: w != "cedex")).alias("a_ntok"), parse_address(address).alias("_a"))
    return rows.select(*[c for c in rows.columns if c != "_a"], "_a.*")
