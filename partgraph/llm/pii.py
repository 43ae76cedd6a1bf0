"""Personal data and secrets: patterns propose spans, checksums confirm them, context words adjust their score.

Everything is a column expression: no Python runs on the executors. A pattern is only tried on texts
that hold the character it needs. Patterns start at the end of the match before or where no character of
their first class stands in front, and repeat possessively, so they find what the plain form finds but
never scan a long run anew from each of its characters.

Spans count code points, end exclusive. Null text is empty and has no spans; a row keeps its other columns,
whatever their names; repeated rows are treated alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partgraph.llm.common import let, text_or_empty, unused

#: Code points of context in front of and behind a span.
BEFORE, AFTER = 40, 20
#: Score from which a proposed span of a kind without a contract counts.
ACCEPT = 0.6
#: Bits a character of a secret has; 20 random hexadecimal digits have 3 nearly always, words and numbers fewer.
SECRET_BITS = 3.0
#: Spans whose lengths are summed at once; keeps long lists of spans out of quadratic time.
BLOCK = 128


# Account number lengths by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU KM LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern() -> str:
    """Account numbers of their country's length where letters and digits end there; any other length else, up to a known country."""
    known = {length: names.replace(" ", "|") for length, names in IBAN_LENGTHS.items()}
    fixed = "|".join(f"(?:{names})[0-9]{{2}}(?: ?[A-Z0-9]){{{length - 4}}}(?![A-Za-z0-9])" for length, names in known.items())
    other = rf"[A-Z]{{2}}[0-9]{{2}}(?:(?! (?:{'|'.join(known.values())})[0-9]{{2}}) ?[A-Z0-9]){{11,30}}"
    return f"(?=[A-Z]{{2}}[0-9]{{2}})(?:{fixed}|{other})"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    return F.call_function("luhn_check", digits(value))


def mod97(value: Column) -> Column:
    """ISO 7064 check of an account number: country and check digits last, letters as 10 to 35, rest 1."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, char: F.when(char == "", rest).otherwise(step(rest, char))) == 1


def mixed(value: Column) -> Column:
    """Letters and digits without a visible order: of each two at least, and a high entropy of characters."""
    chars = F.array_distinct(F.filter(F.split(value, ""), lambda c: c != ""))
    share = lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / F.length(value)
    bits = F.aggregate(chars, F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))
    return value.rlike("[0-9][^0-9]*[0-9]") & value.rlike("[A-Za-z][^A-Za-z]*[A-Za-z]") & (bits >= SECRET_BITS)


def digit_count(least: int, most: int) -> Callable[[Column], Column]:
    return lambda value: F.length(digits(value)).between(least, most)


@dataclass(frozen=True)
class Kind:
    """What proposes, confirms and scores one kind of span."""

    name: str
    pattern: str
    needs: str  # a text without this has no match
    confirm: Callable[[Column], Column]
    score: float
    words: str  # context words, which raise the score
    always: bool = True  # confirmed spans stay whatever the score
    alone: bool = False  # no letter or digit may touch the span


#: Words that name a secret.
SECRET_WORDS = r"token|secret|passw|pwd|api.?key|access.?key|private.?key|credential|authori[sz]ation|bearer"

# The patterns that propose each kind.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        lambda value: F.lit(True),
        0.9,
        r"mail|contact|write",
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        "[0-9]",
        lambda value: value.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"),
        0.7,
        r"\bip\b|address|host|server",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        "[0-9]",
        lambda value: digit_count(12, 19)(value) & luhn(value),
        0.8,
        r"card|visa|credit|payment",
    ),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+", digit_count(9, 15), 0.7, r"phone|tel|call|mobile|fax"),
    Kind(
        "iban",
        iban_pattern(),
        "[0-9]",
        mod97,
        0.9,
        r"iban|account|bank",
        alone=True,
    ),
    Kind(
        "ssn",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        "-",
        lambda value: ~value.rlike("^(?:000|666|9)|-00-|0000$"),
        0.4,
        r"ssn|social security|tax id",
        always=False,
        alone=True,
    ),
    Kind(
        "phone_local",
        r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}",
        "[0-9]",
        lambda value: F.lit(True),
        0.4,
        r"phone|tel|call|mobile|fax",
        always=False,
        alone=True,
    ),
    Kind(
        "secret",
        r"(?<![A-Za-z0-9_+/-])(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|xox[abprs]-|AIza|eyJ)[A-Za-z0-9_+/-]{12,}+",
        r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|xox|AIza|eyJ",
        mixed,
        0.8,
        SECRET_WORDS,
    ),
    Kind(
        "secret_assigned",
        r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+",
        f"(?i){SECRET_WORDS}",
        mixed,
        0.4,
        SECRET_WORDS,
        always=False,
    ),
)
BASE = ("email", "ip", "card", "phone")
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that don't overlap, with their places: array of (start, end, value).

    Splitting gives the text between matches; places are running sums of both lengths, summed in blocks.
    """

    def place(both: Column) -> Column:
        gaps, found = both["gaps"], both["found"]
        sizes = F.zip_with(gaps, found, lambda g, m: F.coalesce(F.length(g), F.lit(0)) + F.coalesce(F.length(m), F.lit(0)))
        total = lambda items: F.aggregate(items, F.lit(0), lambda a, x: a + x)

        def with_blocks(bound: Column) -> Column:
            def one(match: Column, i: Column) -> Column:
                block = F.floor(i / BLOCK).cast("int")
                before = total(F.slice(bound["blocks"], F.lit(1), block)) + total(
                    F.slice(bound["sizes"], block * BLOCK + 1, i - block * BLOCK)
                )
                start = before + F.length(gaps[i])
                return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("value"))

            return F.transform(found, one)

        def with_sizes(sizes: Column) -> Column:
            count = F.floor((F.size(sizes) - 1) / BLOCK).cast("int")
            blocks = F.transform(F.sequence(F.lit(0), count), lambda b: total(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))
            return let(F.struct(sizes.alias("sizes"), blocks.alias("blocks")), with_blocks)

        return let(sizes, with_sizes)

    return let(
        F.struct(
            F.split(text, pattern, -1).alias("gaps"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        ),
        place,
    )


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    none = F.array().cast(SPANS)

    def scored(m: Column) -> Column:
        start, end = m["start"], m["end"]
        lead = F.least(start, F.lit(BEFORE))
        front, behind = F.substr(text, start - lead + 1, lead), F.substr(text, end + 1, F.lit(AFTER))
        near = F.lower(F.concat(front, F.lit(" "), behind)).rlike(kind.words)
        score = F.lit(kind.score) + F.when(near, min(0.3, 0.99 - kind.score)).otherwise(0.0)
        touched = front.rlike("[A-Za-z0-9]$") | behind.rlike("^[A-Za-z0-9]") if kind.alone else F.lit(False)
        return F.struct(
            start.alias("start"),
            F.lit(rank).alias("rank"),
            end.alias("end"),
            F.lit(kind.name).alias("kind"),
            F.when(touched, 0.0).otherwise(F.round(score, 2)).alias("score"),
        )

    confirmed = F.filter(matches(text, kind.pattern), lambda m: kind.confirm(m["value"]))
    all_spans = F.transform(confirmed, scored)
    kept = all_spans if kind.always and not kind.alone else F.filter(all_spans, lambda s: s["score"] >= ACCEPT)
    return F.when(text.rlike(kind.needs) & text.rlike(kind.pattern), kept.cast(SPANS)).otherwise(none)


def find_spans(text: Column) -> Column:
    """All spans of a text, by start and then by kind as listed."""
    return F.array_sort(F.flatten(F.array(*[spans_of(text, kind, rank) for rank, kind in enumerate(KINDS)])))


def with_spans(docs: DataFrame, spans: str = "pii_spans", text: str = "text") -> DataFrame:
    """``docs`` with a column of (start, rank, end, kind, score) for each span; no other column is read."""
    has_any = text_or_empty(text).rlike("[0-9@]")
    return docs.withColumn(spans, F.when(has_any, find_spans(text_or_empty(text))).otherwise(F.array().cast(SPANS)))


def mask(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans become one.

    A span costs one pass over its own text.
    """

    def step(state: Column, span: Column) -> Column:
        gap = F.substr(text, state["at"] + 1, span["start"] - state["at"])
        fresh = span["start"] >= state["at"]
        parts = F.when(fresh, F.concat(state["out"], gap, F.lit("<"), F.upper(span["kind"]), F.lit(">"))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), parts.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))


def span_report(docs: DataFrame) -> DataFrame:
    """Digest of the spans of each row: counts and hash of the base kinds, and all spans as text."""
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    found = with_spans(docs.select("doc_id", "text")).select("doc_id", "pii_spans")
    base = F.filter("pii_spans", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and ``n_chars``, if there is one, counted anew where it changed."""
    spans = unused(docs, "pii_spans")
    found = with_spans(docs, spans)
    changed = F.size(spans) > 0
    masked = found.withColumn("text", F.when(changed, mask(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)
