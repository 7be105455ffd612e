"""Personal data: patterns propose spans, check sums confirm them, words nearby adjust the score.

Spark gives no positions of matches, but the pieces between them: a match starts where the pieces and matches before
it end, counted in code points. A text reaches a kind's patterns only if a cheap test of that kind holds. Patterns start
only where a run of their characters starts and never give back what they took, so their time is linear in the text.
Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldloom.llm.common import bind

#: Code points before a match in which words of context count.
NEAR = 48
KEPT_FROM = 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = lambda c, k: bind(c.cast("int") * (k % 2 + 1), lambda d: F.when(d > 9, d - 9).otherwise(d))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces passes ISO 7064 mod 97-10."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(F.upper(turned), ""), F.lit(0), step) == 1


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: bind(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda x: (F.length(x) <= 3) & (F.coalesce(F.when(F.length(x) <= 3, x.try_cast("int")), F.lit(999)) <= 255)))


def _iso_date(m: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.regexp_replace(m, "[./]", "-"), F.lit("yyyy-MM-dd"))).isNotNull()


def _mixed(m: Column) -> Column:
    """Whether what a credential is set to has letters and digits, as random strings have and words haven't."""
    value = F.regexp_extract(m, r"[A-Za-z0-9_+/=-]{12,}$", 0)
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


@dataclass(frozen=True)
class Kind:
    """gate: cheap test of a text; score: of a confirmed match, to which words of context add near."""

    name: str
    gate: str
    pattern: str
    valid: Callable[[Column], Column] | None
    base: bool
    score: float
    context: str = ""
    near: float = 0.3


#: In the order in which spans are listed. The first four are fixed by the contract; their score never drops them.
KINDS = (
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, True, 0.9, r"(?i)e-?mail|correo|courriel|contact|kontakt"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets, True, 0.7, r"(?i)\bip\b|host|server|addr"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){15}", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", lambda m: bind(_digits(m), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)), True, 0.8, r"(?i)card|visa|carte|karte|tarjeta"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(8, 15), True, 0.7, r"(?i)phone|tel|call|mobile|appel|anruf|llam"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda m: bind(F.replace(m, F.lit(" "), F.lit("")), lambda x: F.when(F.length(x).between(15, 34), mod97(x)).otherwise(False)), False, 0.8, r"(?i)iban|account|konto|compte|cuenta"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), False, 0.4, r"(?i)ssn|social security"),
    Kind("secret", r"(?i)key|secret|token|passw|pwd|credential", r"(?i)(?<![A-Za-z0-9])(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|(?:auth[_-]?|access[_-]?)?token|passw(?:or)?d|pwd|credential)[\"']?\x20{0,4}[:=]\x20{0,4}[\"']?[A-Za-z0-9_+/=-]{12,}+", _mixed, False, 0.6, r"(?i)auth|login|header|export|bearer"),
    Kind("key_id", r"AKIA|ASIA|ghp_|gho_|xox[bap]-|eyJ", r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[po]_[A-Za-z0-9]{36}|xox[bap]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9])", None, False, 0.9, r"(?i)key|token|auth"),
    Kind("birth_date", r"[0-9]{4}[-./][0-9]{2}[-./][0-9]{2}", r"(?<![0-9])[0-9]{4}([-./])[0-9]{2}\1[0-9]{2}(?![0-9])", _iso_date, False, 0.2, r"(?i)\bborn\b|birth|geboren|naissance|nacimiento", 0.5),
)


#: Matches whose places are found one after another; their blocks are found each for itself.
TOGETHER = 128


def spans_of(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, score>> of a kind's confirmed matches, in order of start."""
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    no_rows = F.array().cast("array<struct<start:bigint,m:string,before:string>>")
    added = lambda acc, x: acc + x

    def located(t: Column) -> Column:
        found, pieces = F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0)), F.split(t, kind.pattern)
        zero = F.lit(0).cast("long")

        def add(a: Column, x: Column) -> Column:
            at = a["at"] + F.length(x["piece"])
            row = F.struct(at.alias("start"), x["m"].alias("m"), F.right(x["piece"], F.lit(NEAR)).alias("before"))
            return F.struct((at + F.length(x["m"])).alias("at"), F.concat(a["out"], F.array(row)).alias("out"))

        pairs = bind(F.struct(found.alias("f"), pieces.alias("p")), lambda s: F.transform(s["f"], lambda m, i: F.struct(m.alias("m"), F.get(s["p"], i).alias("piece"))))

        def of_block(block: Column, at: Column) -> Column:
            return F.aggregate(block, F.struct(at.alias("at"), no_rows.alias("out")), add, lambda a: a["out"])

        def summed(blocks: Column) -> Column:
            """Lists grow within a block of TOGETHER matches only, so the work doesn't grow with the square of the matches."""
            sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + F.length(x["piece"]) + F.length(x["m"])))
            return bind(sums, lambda s: F.flatten(F.transform(blocks, lambda b, k: of_block(b, F.aggregate(F.slice(s, F.lit(1), k), zero, added)))))

        cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / TOGETHER).cast("int")), lambda k: F.slice(p, k * TOGETHER + 1, F.lit(TOGETHER)))
        return bind(pairs, lambda p: F.when(F.size(p) > 0, bind(cut(p), summed)).otherwise(no_rows))

    def judged(rows: Column) -> Column:
        valid = F.filter(rows, lambda r: kind.valid(r["m"])) if kind.valid else rows
        near = lambda r: F.when(r["before"].rlike(kind.context), kind.near).otherwise(0.0)
        scored = F.transform(valid, lambda r: F.struct(F.lit(kind.name).alias("kind"), r["start"].alias("start"), (r["start"] + F.length(r["m"])).alias("end"), F.least(F.lit(1.0), F.lit(kind.score) + near(r)).alias("score")))
        return scored if kind.base else F.filter(scored, lambda r: r["score"] >= KEPT_FROM)

    return F.when(text.rlike(kind.gate), judged(located(text))).otherwise(none)


def find_pii(docs: DataFrame, text: str = "text", key: str = "doc_id", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row per row of docs: key and spans, an array of (kind, start, end, score) by kind as listed, then start.

    Offsets are in code points of the text, the end exclusive. Null and empty texts have no spans. Kinds beyond the base may
    overlap others. Repeated rows give repeated rows, an empty table an empty result, other columns are left out.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    some = F.col("t").rlike("[0-9@]")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    return rows.select(F.col("key").alias(key), F.when(some, F.concat(*(spans_of(F.col("t"), k) for k in kinds))).otherwise(none).alias("spans"))
