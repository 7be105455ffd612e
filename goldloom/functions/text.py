"""Text normalisers as column expressions; blank values become null unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for flags and sexes, in lower case.
TRUE_WORDS = ("1", "true", "t", "yes", "y", "tak", "prawda")
FALSE_WORDS = ("0", "false", "f", "no", "n", "nie", "falsz", "fałsz")
FEMALE_WORDS = ("1", "k", "kobieta", "female", "f")
MALE_WORDS = ("0", "m", "mezczyzna", "mężczyzna", "male")

# Patterns of legal forms in order, the first that is found wins.
LEGAL_FORMS = (
    (r"\bS\.?\s*A\.?\b", "S.A."),
    (r"\bSPÓŁKA\s+AKCYJNA\b", "S.A."),
    (r"\bSPOLKA\s+AKCYJNA\b", "S.A."),
    (r"\bSP(?:ÓŁKA)?\.?\s*Z\.?\s*O\.?\s*O\.?\b", "SP. Z O.O."),
    (r"\bSPÓŁKA\s+Z\s+OGRANICZONĄ\s+ODPOWIEDZIALNOŚCIĄ\b", "SP. Z O.O."),
    (r"\bSPOLKA\s+Z\s+OGRANICZONA\s+ODPOWIEDZIALNOSCIA\b", "SP. Z O.O."),
    (r"\bSP\.?\s*J\.?\b", "SP. J."),
    (r"\bSP\.?\s*K\.?\b", "SP. K."),
    (r"\bS\.?\s*K\.?\s*A\.?\b", "S.K.A."),
    (r"\bS\.?\s*C\.?\b", "S.C."),
    (r"\bFUNDACJ[AE]\b", "FUNDACJA"),
    (r"\bSTOWARZYSZENI[EA]\b", "STOWARZYSZENIE"),
)
LEGAL_FORM_CODES = {"LLCPL": "SP. Z O.O.", "JSCPL": "S.A."}
#: Unicode classes and case folding, as the patterns mean them.
_U = "(?iuU)"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value as a variable, where plain reuse would repeat the whole expression."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def sanitize(c: Column) -> Column:
    """Without characters that can't be printed (the plain space stays), trimmed; blanks stay as empty text."""
    return F.trim(F.regexp_replace(c, r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ ]]", ""))


def compact(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def is_blank(c: Column) -> Column:
    return compact(c).isNull()


def text_key(c: Column) -> Column:
    """Compact upper-case text; diacritics stay."""
    return F.upper(compact(c))


def identifier(c: Column) -> Column:
    """Upper-case letters and digits alone; may be empty where there are none."""
    return F.regexp_replace(text_key(c), "[^0-9A-Z]+", "")


def city(c: Column) -> Column:
    """Upper case, without postal codes in the text; a text that repeats itself ("X X") is halved."""

    def halve(plain: Column) -> Column:
        tokens = F.split(plain, " ")
        half = F.greatest(F.floor(F.size(tokens) / 2).cast("int"), F.lit(1))
        first, second = F.slice(tokens, F.lit(1), half), F.slice(tokens, half + 1, half)
        return F.when((F.size(tokens) >= 2) & (F.size(tokens) % 2 == 0) & (first == second), F.array_join(first, " ")).otherwise(plain)

    return bind(compact(F.regexp_replace(text_key(c), r"(?U)\b\d{2}-\d{3}\b", " ")), halve)


def postal_code(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9]+", "")
    code = F.concat_ws("-", F.substring(digits, 1, 2), F.substring(digits, 3, 3))
    return F.when(compact(c).isNull(), None).when(F.length(digits) == 5, code).otherwise(text_key(c))


def phone(c: Column) -> Column:
    """E.164 for numbers of nine digits (Polish) and those that say their country; else the digits."""
    digits = F.regexp_replace(compact(c), "[^0-9]+", "")
    return (
        F.when(F.coalesce(F.length(digits), F.lit(0)) == 0, None)
        .when(F.length(digits) == 9, F.concat(F.lit("+48"), digits))
        .when(digits.startswith("48") & (F.length(digits) == 11), F.concat(F.lit("+"), digits))
        .when(F.trim(c).startswith("+"), F.concat(F.lit("+"), digits))
        .otherwise(digits)
    )


def email(c: Column) -> Column:
    return F.lower(compact(c))


def website(c: Column) -> Column:
    return F.regexp_replace(F.lower(compact(c)), r"^(?:https://)?(?:http://)?(?:www\.)?", "")


def _first_form(c: Column, then) -> Column:
    return F.coalesce(*(F.when(c.rlike(_U + p), then(p, label)) for p, label in LEGAL_FORMS))


def legal_form(c: Column) -> Column:
    """Label of the first legal form named in a text."""
    return _first_form(compact(c), lambda p, label: F.lit(label))


def legal_entity_type(c: Column) -> Column:
    """Legal form by code, then by name, else the text's key."""
    key = text_key(c)
    code = F.regexp_replace(key, "[^0-9A-Z]+", "")
    by_code = F.coalesce(*(F.when(code == k, F.lit(v)) for k, v in LEGAL_FORM_CODES.items()))
    return F.coalesce(by_code, legal_form(key), key)


def short_name(c: Column) -> Column:
    """A party's name without the first legal form named in it and without separators at its ends."""
    text = compact(c)
    edge = r"(?U)^[\s,.;:-]+|[\s,.;:-]+$"
    cut = _first_form(text, lambda p, _: compact(F.regexp_replace(compact(F.regexp_replace(text, _U + p, " ")), edge, "")))
    return F.when(legal_form(text).isNotNull(), cut).otherwise(text)


def registration_kind(c: Column) -> Column:
    """KRS or REGON, where a registration authority's name says so."""
    key = text_key(c)
    named = lambda *words: reduce(lambda a, b: a | b, (key.contains(w) for w in words))
    return F.when(named("RA000466", "KRS", "COURT REGISTER"), "KRS").when(named("RA000484", "REGON", "BUSINESS REGISTER"), "REGON")


def flag(c: Column) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def is_female(c: Column) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*FEMALE_WORDS), True).when(word.isin(*MALE_WORDS), False)


def json_list(c: Column) -> Column:
    """array<string> of a JSON array; other JSON becomes its one element, other text is split at commas."""
    text = F.nullif(F.trim(c), F.lit(""))
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    valid = F.try_parse_json(text)
    one = F.array(F.coalesce(F.try_variant_get(valid, "$", "string"), text))
    return F.when(valid.isNull(), parts).when(text.startswith("["), F.coalesce(F.from_json(text, "array<string>"), parts)).otherwise(one)


def parse_list(c: Column) -> Column:
    """array<string> of a JSON array; anything else gives an empty array."""
    return F.coalesce(F.when(F.try_parse_json(c).isNotNull() & F.trim(c).startswith("["), F.from_json(c, "array<string>")), F.array().cast("array<string>"))


def json_key(c: Column) -> Column:
    """JSON text with sorted keys, in upper case; text that isn't JSON as text_key."""
    valid = F.try_parse_json(c)
    return F.when(valid.isNull(), text_key(c)).otherwise(text_key(F.to_json(valid)))


def identifiers(c: Column) -> Column:
    """map<string,string> of a JSON object; anything else gives an empty map."""
    ok = F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{")
    return F.coalesce(F.when(ok, F.from_json(c, "map<string,string>")), F.create_map().cast("map<string,string>"))


def full_name(*parts: Column) -> Column:
    return compact(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts)))


def slug(c: Column) -> Column:
    """Letters and digits in lower case, a hyphen for each other character, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "-"), "^-+|-+$", "")


def upper_trim(c: Column) -> Column:
    return F.upper(F.trim(c))
