"""Personal data by patterns, checksums and context, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aquatally.llm.util import quoted, running_sum, without

# Fixed values.  The guards and possessive repeats change no match: they only keep long runs
# of one class from being tried again from each of their characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
}
BASE = ("email", "ip", "card", "phone")
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write|kontakt|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|telefon|telefono)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
}
#: Score of a bare match; a checksum or range that holds and a context word near it add to it.
PRIOR = {"email": 0.6, "ip": 0.5, "card": 0.2, "phone": 0.5, "iban": 0.4}
CONFIRMED, NEAR = 0.35, 0.2
THRESHOLD = 0.7
BEFORE, AFTER = 40, 20


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        value = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = value * 2
        return total + F.when(i % 2 == 1, value).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether letters and digits, without spaces, pass the mod-97 check of account numbers."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def _matches(text: Column, kind: str) -> Column:
    """All matches of a kind; texts without a character that it needs are not searched."""
    needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    worth = needs.get(kind, text.rlike("[0-9]"))
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    return F.when(worth, found).otherwise(F.array().cast("array<string>"))


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``: (kind, start, end, score, base, value) in code points, end exclusive.

    Spans come by kind (email, ip, card, phone, iban), then start.  Those of the base rules
    always stay: emails, addresses with parts up to 255, 16 to 19 digits passing Luhn, 8 to 15
    digits after a plus sign.  Others stay if their score reaches the threshold: account numbers
    that pass mod 97, and 13 to 15 digits passing Luhn beside a word on cards.  A score grows with
    the check and with context words within 40 characters before or 20 after, as far as the
    neighbouring matches of its kind.  Null or empty
    text has no spans; a column called ``spans`` is replaced, and others pass whatever their names.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so that none clashes with a working column
    kept = without(docs, ["spans"])
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    own = docs.select(*[quoted(c).alias(names[c]) for c in kept], text.alias("text"))
    text = F.col("text")
    out = own.select("*", *[_matches(text, k).alias(f"__m_{k}") for k in PATTERNS])
    # what lies between the matches gives both their places and their context
    gaps = [
        F.when(F.size(f"__m_{k}") > 0, F.split(text, PATTERNS[k], -1)).alias(f"__g_{k}") for k in PATTERNS
    ]
    out = out.select("*", *gaps)
    out = out.select("*", *[_steps(k).alias(f"__s_{k}") for k in PATTERNS])
    out = out.select(
        "*",
        *[F.when(F.col(f"__s_{k}").isNotNull(), running_sum(F.col(f"__s_{k}"))).alias(f"__p_{k}") for k in PATTERNS],
    )
    spans = [_spans(k) for k in PATTERNS]
    return out.select(*[names[c] for c in kept], F.concat(*spans).alias("spans")).toDF(*kept, "spans")


def _steps(kind: str) -> Column:
    """From each match's start to the next one's."""
    matches, gaps = F.col(f"__m_{kind}"), F.col(f"__g_{kind}")

    def step(_: Column, i: Column) -> Column:
        last = F.when(i > 0, F.char_length(F.get(matches, i - 1))).otherwise(0)
        return (F.char_length(F.get(gaps, i)) + last).cast("long")

    return F.when(F.size(matches) > 0, F.transform(matches, step))


def _spans(kind: str) -> Column:
    m, g, p = (F.col(f"__{x}_{kind}") for x in "mgp")

    def judged(value: Column, i: Column) -> Column:
        digits = F.regexp_replace(value, "[^0-9]", "")
        number = F.length(digits)
        near = F.right(F.get(g, i), F.lit(BEFORE)).rlike(CONTEXT[kind]) | F.left(F.get(g, i + 1), F.lit(AFTER)).rlike(
            CONTEXT[kind]
        )
        if kind == "email":
            holds = base = F.lit(True)
        elif kind == "ip":
            holds = base = value.rlike(IP_PARTS)
        elif kind == "phone":
            holds = base = number.between(8, 15)
        elif kind == "card":
            holds = F.when(number.between(13, 19), luhn(digits)).otherwise(False)
            base = holds & (number >= 16)
        else:
            account = F.replace(value, F.lit(" "), F.lit(""))
            holds = F.when(F.length(account).between(15, 34), mod_97(account)).otherwise(False)
            base = F.lit(False)
        score = PRIOR[kind] + F.when(holds, CONFIRMED).otherwise(0.0) + F.when(near, NEAR).otherwise(0.0)
        start = F.get(p, i)
        return F.struct(
            F.lit(kind).alias("kind"),
            start.alias("start"),
            (start + F.char_length(value)).alias("end"),
            score.alias("score"),
            (base).alias("base"),
            holds.alias("holds"),
            value.alias("value"),
        )

    found = F.filter(F.transform(m, judged), lambda s: s["base"] | (s["holds"] & (s["score"] >= THRESHOLD)))
    return F.transform(
        found,
        lambda s: F.struct(
            *[s[c].alias(c) for c in ("kind", "start", "end", "score", "base", "value")],
        ),
    )


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")),
        ),
        ",",
    )
