"""Text normalisation as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# US state names and codes.
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE", "DISTRICT OF COLUMBIA": "DC",
    "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME",
    "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV",
    "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR",
    "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA",
    "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
}
# Street suffixes by their short forms; company suffixes.
STREET_SUFFIXES = {
    "ST": "STREET", "STR": "STREET", "AVE": "AVENUE", "AV": "AVENUE", "RD": "ROAD", "DR": "DRIVE", "LN": "LANE", "BLVD": "BOULEVARD", "CT": "COURT", "CRT": "COURT",
    "PL": "PLACE", "HWY": "HIGHWAY", "PKWY": "PARKWAY", "CIR": "CIRCLE", "TRL": "TRAIL", "SQ": "SQUARE", "TER": "TERRACE", "TERR": "TERRACE",
}
COMPANY_SUFFIXES = {"INCORPORATED": "INC", "CORPORATION": "CORP", "COMPANY": "CO", "LIMITED": "LTD"}
UNITS = ("APT", "APARTMENT", "UNIT", "SUITE", "STE", "FLOOR", "FL", "ROOM", "RM")
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "with")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value of a small fixed map, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def collapse(x) -> Column:
    return F.regexp_replace(_c(x), r"\s+", " ")


def normalise(x, case: str = "upper", punctuation: bool = False) -> Column:
    """Strip, change case, collapse white space and, if asked, delete ASCII punctuation. Null is empty."""
    s = F.trim(F.coalesce(_c(x).cast("string"), F.lit("")))
    s = F.upper(s) if case == "upper" else F.lower(s) if case == "lower" else s
    return collapse(remove_punctuation(s) if punctuation else s)


def remove_punctuation(x) -> Column:
    return F.regexp_replace(_c(x), "[" + "".join("\\" + ch for ch in string.punctuation) + "]", "")


def digits_only(x) -> Column:
    return F.regexp_replace(_c(x), r"[^0-9]", "")


def alphanumeric_only(x) -> Column:
    return F.regexp_replace(_c(x), r"[^\p{L}\p{N}]", "")


def e164(x) -> Column:
    """+1 and ten digits, else + and the digits; null without digits."""
    d = digits_only(x)
    return F.when(F.length(d) == 10, F.concat(F.lit("+1"), d)).when(F.length(d) > 0, F.concat(F.lit("+"), d))


def state_code(x) -> Column:
    """A state's code from its name; other values upper-cased and without punctuation."""
    s = F.trim(collapse(remove_punctuation(F.upper(_c(x)))))
    return F.coalesce(lookup(STATES, s), s)


def last_token(x, values: dict[str, str]) -> Column:
    """Upper-cased, with the last word replaced by its short form."""
    w = F.split(normalise(x), " ")
    last = F.element_at(w, -1)
    return F.array_join(F.concat(F.slice(w, 1, F.size(w) - 1), F.array(F.coalesce(lookup(values, F.rtrim(last, F.lit("."))), last))), " ")


def street_suffix(x) -> Column:
    return last_token(x, STREET_SUFFIXES)


def company_suffix(x) -> Column:
    return last_token(x, COMPANY_SUFFIXES)


def missing_sentinels(x, values: tuple[str, ...] = ("n/a", "na", "null", "none", "unknown", "-", "")) -> Column:
    return F.when(F.lower(F.trim(_c(x))).isin(*values), F.lit("")).otherwise(_c(x))


def expand_tokens(x, values: dict[str, str] | None = None, stop_at: tuple[str, ...] = UNITS) -> Column:
    """Upper case, punctuation as spaces, tokens replaced, and all from a unit's designator on left out."""
    w = F.filter(F.split(F.trim(F.regexp_replace(F.upper(F.coalesce(_c(x), F.lit(""))), r"[^A-Z0-9]+", " ")), " "), lambda t: t != "")
    units = F.array(*[F.lit(u) for u in stop_at])
    at = F.filter(F.transform(w, lambda t, i: F.when(F.array_contains(units, t), i)), lambda i: i.isNotNull())
    w = F.when(F.size(at) > 0, F.slice(w, 1, F.element_at(at, 1))).otherwise(w) if stop_at else w
    return F.array_join(F.transform(w, lambda t: F.coalesce(lookup(values or STREET_SUFFIXES, t), t)), " ")


def postal5(x) -> Column:
    return F.substring(digits_only(x), 1, 5)


def tokens(x, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct lower-case runs of ASCII letters and digits, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.array_except(found, F.array(*[F.lit(w) for w in stop_words])) if stop_words else found


def acronym(x, least: int = 4) -> Column:
    """First letters of the words of at least so many letters."""
    w = F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.upper(F.array_join(F.transform(F.filter(w, lambda t: F.length(t) >= least), lambda t: F.substring(t, 1, 1)), ""))


def soundex_simple(x) -> Column:
    """A first character and three digits. Letters without a code vanish first, then equal neighbours merge; the first
    character never merges with what follows. Spark's ``soundex`` has the standard rules."""
    s = F.trim(F.upper(F.coalesce(_c(x), F.lit(""))))
    codes = F.translate(F.regexp_replace(F.substring(s, 2, 1 << 20), "[^BFPVCGJKQSXZDTLMNR]", ""), "BFPVCGJKQSXZDTLMNR", "111122222222334556")
    return F.when(s == "", F.lit("0000")).otherwise(F.rpad(F.concat(F.substring(s, 1, 1), F.regexp_replace(codes, r"(\d)\1+", "$1")), 4, "0"))


def valid_email(x) -> Column:
    return F.coalesce(_c(x).rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"), F.lit(False))


def valid_phone(x) -> Column:
    return F.coalesce(F.length(digits_only(x)).between(10, 15), F.lit(False))


def valid_zip(x) -> Column:
    return F.coalesce(_c(x).rlike(r"^\d{5}(-\d{4})?$"), F.lit(False))


def valid_state(x) -> Column:
    return F.coalesce(F.upper(F.trim(_c(x))).isin(*STATES.values()), F.lit(False))


def field_value(name: str, x) -> Column:
    """A field's value by the rules of its name: e-mail, phone, names and places, address."""
    v = F.trim(F.coalesce(_c(x).cast("string"), F.lit("")))
    if name == "email":
        return F.lower(v)
    if name == "phone":
        return digits_only(v)
    if name in ("first_name", "last_name", "company", "city", "state"):
        return F.initcap(v)
    if name == "address":
        for short, long in (("St", "Street"), ("Ave", "Avenue"), ("Rd", "Road"), ("Dr", "Drive")):
            v = F.regexp_replace(F.initcap(v) if short == "St" else v, rf"\b{short}\.?\b", long)
    return v


def field_features(name: str, x) -> Column:
    """Blocking features of a field: its value, and a prefix, code, domain, area code or first word."""
    v = field_value(name, x)
    more = {
        "first_name": [F.when(F.length(v) >= 3, F.substring(v, 1, 3)), soundex_simple(v)],
        "last_name": [F.when(F.length(v) >= 3, F.substring(v, 1, 3)), soundex_simple(v)],
        "email": [F.when(F.contains(v, F.lit("@")), F.split_part(v, F.lit("@"), F.lit(2)))],
        "phone": [F.when(F.length(v) >= 10, F.substring(v, 1, 3))],
        "address": [F.split_part(v, F.lit(" "), F.lit(1))],
    }.get(name, [])
    return F.when(v == "", F.array().cast("array<string>")).otherwise(F.filter(F.array(v, *more), lambda f: f.isNotNull()))


#: Transformers by name, for configurations.
TRANSFORMERS = {
    "strip": lambda c: F.trim(c), "lower": lambda c: F.lower(c), "upper": lambda c: F.upper(c), "collapse_whitespace": collapse, "remove_punctuation": remove_punctuation,
    "digits_only": digits_only, "alphanumeric_only": alphanumeric_only, "e164": e164, "state_code": state_code, "street_suffix": street_suffix, "company_suffix": company_suffix,
    "missing_sentinels": missing_sentinels, "soundex": lambda c: F.soundex(c),
}


def valid_collection(x) -> Column:
    """A letter, then letters, digits and underscores; at most 256 in all."""
    return F.coalesce(_c(x).rlike(r"^[a-zA-Z][a-zA-Z0-9_]{0,255}$"), F.lit(False))


def valid_field(x, nested: bool = True) -> Column:
    """Letters, digits and underscores, not a digit first; parts between dots if nested. At most 256 in all."""
    part = "[a-zA-Z_][a-zA-Z0-9_]*"
    fits = _c(x).rlike(f"^{part}(\\.{part})*$" if nested else f"^{part}$")
    return F.coalesce(fits & (F.length(_c(x)) <= 256), F.lit(False))
