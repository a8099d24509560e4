"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

``find`` is one narrow projection of built-in functions: no shuffle, no Python.
Every pattern walks a text in linear time: repeats are possessive, and a pattern
that could start anywhere in a run of its own characters starts only at the
run's beginning or where the last match ended, which finds the same matches.

Null and empty texts have no spans.  Repeated rows each get their own result.
Columns of the table other than the named ones are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigsift.functions.text import running_sums
from sigsift.llm.common import whole


@dataclass(frozen=True)
class Kind:
    """A sort of personal data.

    ``base`` spans stay whatever their score; others need ``THRESHOLD``.
    ``context`` are words, any case, that raise the score when they stand before
    or after the span, with no other span of the kind between.
    """

    name: str
    pattern: str
    base: bool
    score: float
    context: tuple[str, ...] = field(default=())


THRESHOLD = 0.6
NEAR = 40
CONTEXT_BONUS = 0.3
CHECKSUM_BONUS = 0.4

#: Characters of an account number by its country; the registry, and countries that use the form without being in it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """A number of its country's length, or of any length where the country is not known."""
    known = [
        f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + f"\\x20?[A-Z0-9]{{{n % 4}}}" * (n % 4 > 0)
        for n, names in IBAN_LENGTHS.items()
    ]
    names = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    other = rf"(?!{names})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}+(?:\x20?[A-Z0-9]{{1,3}})?+"
    return rf"(?<![A-Za-z0-9])(?:{'|'.join([*known, other])})(?![A-Za-z0-9])"


# The order of kinds breaks ties between spans with one start.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, 0.8, ("mail", "contact")),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True, 0.6, ("ip", "host", "server", "address")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", True, 0.4, ("card", "visa", "credit", "debit", "pay")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True, 0.6, ("phone", "tel", "call", "mobile", "fax")),
    Kind("iban", _iban(), False, 0.3, ("iban", "account", "bank", "konto")),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", False, 0.4, ("ssn", "social", "security")),
)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value, others left out, pass the Luhn check."""
    turned = F.split(F.reverse(_digits(value)), "")
    def weigh(digit, n):
        number = digit.cast("int")
        return F.when(n % 2 == 0, number).when(number > 4, number * 2 - 9).otherwise(number * 2)
    return F.aggregate(F.transform(turned, weigh), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number, its first four characters moved to the end, leaves 1 when divided by 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    def take(rest, c):
        return F.when(c.between("0", "9"), (rest * 10 + c.cast("int")) % 97).when(c == "", rest).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: take(a, c).cast("int")) == 1


def _valid(kind: str, value: Column) -> Column:
    """The check of a kind; a value that fails it is no span."""
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


def _proposals(frame: DataFrame, kind: Kind, text: str) -> DataFrame:
    """Adds the array ``_<kind>`` of (start, ord, kind, end, value, score), offsets in code points, end exclusive."""
    m, p, s, out = (f"_{x}_{kind.name}" for x in ("found", "between", "starts", "spans"))
    order = [k.name for k in KINDS].index(kind.name)
    frame = frame.withColumn(m, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)))
    frame = frame.withColumn(p, F.when(F.size(m) > 0, F.split(text, kind.pattern, -1)).otherwise(F.array().cast("array<string>")))
    frame = frame.withColumn(s, F.transform(m, lambda x, n: F.length(x) + F.length(F.get(F.col(p), n))))
    frame = frame.withColumn(s, F.when(F.size(s) > 0, running_sums(F.col(s))).otherwise(F.array().cast("array<int>")))
    checked = 1.0 if kind.name in ("card", "iban") else 0.0
    near = "(?i)" + "|".join(kind.context)

    def span(value, n):
        start = F.get(F.col(s), n) + F.length(F.get(F.col(p), n))
        around = F.concat(F.right(F.get(F.col(p), n), F.lit(NEAR)), F.lit(" "), F.left(F.get(F.col(p), n + 1), F.lit(NEAR)))
        score = F.least(F.lit(1.0), F.lit(kind.score + CHECKSUM_BONUS * checked) + F.when(F.rlike(around, F.lit(near)), CONTEXT_BONUS).otherwise(0.0))
        return F.struct(
            start.cast("bigint").alias("start"), F.lit(order).alias("ord"), F.lit(kind.name).alias("kind"),
            (start + F.length(value)).cast("bigint").alias("end"), value.alias("value"), score.alias("score"),
        )

    kept = F.filter(F.transform(m, span), lambda x: _valid(kind.name, x["value"]))
    if not kind.base:
        kept = F.filter(kept, lambda x: x["score"] >= THRESHOLD)
    return frame.withColumn(out, kept).drop(m, p, s)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, spans): arrays of (start, ord, kind, end, value, score) in order of start, then kind.

    ``base`` has the four kinds every text is searched for; ``spans`` has these
    and what the checksums and the words nearby confirm beyond them.
    """
    frame = docs.select(F.col(key).alias("_key"), whole(F.col(text)).alias("_text"))
    for kind in KINDS:
        frame = _proposals(frame, kind, "_text")
    of = lambda kinds: F.array_sort(F.concat(*[F.col(f"_spans_{k.name}") for k in kinds]))
    return frame.select(F.col("_key").alias(key), of([k for k in KINDS if k.base]).alias("base"), of(KINDS).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
