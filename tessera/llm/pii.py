"""Personal data: regular expressions propose spans, checksums confirm them,
nearby context words adjust the score.  DataFrame functions only.

The patterns use possessive groups and look-behind, so that a match needs no
backtracking and no recursion however long the text is; they match the same
spans as the plain patterns given beside them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ROW, pack, text_of, unpack

#: Characters before and after a match that are searched for context words.
CONTEXT = 40
#: Spans of this score or more are reported.
THRESHOLD = 0.6
BLOCK = 64


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def _luhn(m: Column) -> Column:
    """13 to 19 digits whose Luhn sum ends in 0."""
    d = _digits(m)
    n = F.length(d)

    def step(total, i):
        x = F.substr(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.when(_between(n, 13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0).otherwise(False)


def _mod97(m: Column) -> Column:
    """15 to 34 characters of which the rearranged number is 1 modulo 97."""
    s = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))

    def step(rest, i):
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.when(_between(F.length(s), 15, 34),
                  F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1).otherwise(False)


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: p.rlike(r"^0*+(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$"))


def _phone(m: Column) -> Column:
    return _between(F.length(_digits(m)), 9, 15)


@dataclass(frozen=True)
class Kind:
    name: str
    #: plain form, as in the oracle
    plain: str
    pattern: str
    valid: object
    score: float
    #: words that raise the score, and by how much
    context: str
    bonus: float
    #: a text without this character has no match
    needs: str


#: Base kinds score above the threshold without context, so their spans stay.
KINDS = [
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         None, 0.9, "mail|contact|write|adresse|correo", 0.1, "@"),
    Kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets, 0.7, "ip|host|server|address|login", 0.2, "."),
    Kind("card", r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9])++", _luhn, 0.8,
         "card|visa|credit|karte|carte|tarjeta|payment", 0.2, ""),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 0.7,
         "tel|phone|call|fax|mobile|telefon", 0.2, "+"),
    Kind("iban", r"[A-Z][A-Z][0-9][0-9]( ?[A-Z0-9])+",
         r"[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9])++", _mod97, 0.8, "iban|bank|konto|account|compte|cuenta", 0.2, ""),
    Kind("ssn", r"[0-9]+-[0-9]+-[0-9]+", r"(?<![0-9])[0-9]++-[0-9]++-[0-9]++",
         lambda m: m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), 0.3, "ssn|social security", 0.5, "-"),
]
BASE = [k.name for k in KINDS[:4]]


def _sums(values: Column) -> Column:
    """Sums of blocks of ``BLOCK`` array elements."""
    blocks = F.ceil(F.size(values) / F.lit(BLOCK)).cast("int")
    return F.transform(F.sequence(F.lit(0), blocks - 1),
                       lambda b: F.aggregate(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x))


def _before(values: Column, block_sums: Column, i: Column) -> Column:
    """Sum of the first ``i`` elements, from whole blocks and the rest."""
    b = F.floor(i / F.lit(BLOCK)).cast("int")
    whole = F.aggregate(F.slice(block_sums, F.lit(1), b), F.lit(0), lambda a, x: a + x)
    return F.aggregate(F.slice(values, b * BLOCK + 1, i - b * BLOCK), whole, lambda a, x: a + x)


def find_pii(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The input's columns plus ``spans``, an array of
    (kind, start, end, score, value) by kind and start, offsets in code points,
    end exclusive.

    Per kind the leftmost non-overlapping matches are taken, failing ones are
    dropped without another try.  The score is the kind's own, raised when a
    context word stands within ``CONTEXT`` characters; spans below
    ``threshold`` go.  Defined cases: null and empty texts have no spans;
    repeated rows are scanned each on its own; an input column named ``spans``
    is replaced; ids are not used.
    """
    df = pack(docs).select(ROW, text_of(text_col).alias("t"))
    found, gaps, sizes, sums = {}, {}, {}, {}
    for k in KINDS:
        all_of = F.regexp_extract_all("t", F.lit(k.pattern), F.lit(0))
        none = F.array().cast("array<string>")
        found[f"m_{k.name}"] = F.when(F.contains("t", F.lit(k.needs)), all_of).otherwise(none) if k.needs else all_of
        m, g, n = (F.col(f"{x}_{k.name}") for x in "mgn")
        some = F.size(m) > 0
        gaps[f"g_{k.name}"] = F.when(some, F.split("t", k.pattern, -1))
        sizes[f"n_{k.name}"] = F.when(some, F.zip_with(m, g, lambda x, y: F.coalesce(F.length(x), F.lit(0))
                                                       + F.length(y)))
        sums[f"s_{k.name}"] = F.when(some, _sums(n))
    for made in (found, gaps, sizes, sums):
        df = df.select("*", *[v.alias(c) for c, v in made.items()])

    def spans(k: Kind) -> Column:
        m, g, n, s = (F.col(f"{x}_{k.name}") for x in "mgns")

        def span(x, i):
            gap = F.get(g, i)
            start = _before(n, s, i) + F.length(gap)
            near = F.concat_ws(" ", F.right(gap, F.lit(CONTEXT)), F.left(F.get(g, i + 1), F.lit(CONTEXT)))
            bonus = F.when(F.lower(near).rlike(k.context), k.bonus).otherwise(0.0)
            return F.struct(F.lit(k.name).alias("kind"), start.cast("long").alias("start"),
                            (start + F.length(x)).cast("long").alias("end"),
                            F.least(F.lit(1.0), F.lit(k.score) + bonus).alias("score"), x.alias("value"))

        def good(x):
            keep = x["score"] >= threshold
            return keep if k.valid is None else k.valid(x["value"]) & keep

        empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double,value:string>>")
        return F.when(F.size(m) > 0, F.filter(F.transform(m, span), good)).otherwise(empty)

    return unpack(df.select(ROW, F.concat(*[spans(k) for k in KINDS]).alias("spans")), docs.columns,
                  spans=F.col("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
