"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score.

Everything is column expressions. A pattern's matches are set off by a mark, the text is split at
the marks, and running sums of the pieces' lengths give offsets in code points. A row stays a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = ""
STAND_IN = "�"
NEARBY = 40

# Kinds in the order of the report, with the pattern, the cheap test that a text can
# hold one, the score of a confirmed span, and words that raise or lower it. Patterns match what the
# plain forms match; possessive repeats and the looks behind keep them linear in the text.
_LOCAL = "A-Za-z0-9._%+-"
KINDS = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8,
              ("mail", "contact", "write", "correo", "courriel"), ("example", "git@")),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", 0.6,
           ("ip", "host", "server", "address", "login", "from"), ("version", "release", "section", "chapter")),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}", 0.7,
             ("card", "visa", "credit", "karte", "carte", "tarjeta", "pay"), ("isbn", "order", "serial", "tracking")),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6,
              ("phone", "call", "tel", "mobile", "fax", "ring"), ("score", "utc", "gmt")),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
             r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{11}", 0.9, ("iban", "bank", "account", "konto", "cuenta"), ()),
}
BASE = ("email", "ip", "card", "phone")
SPAN = "array<struct<start:bigint,end:bigint,score:double>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def mod97(match: Column) -> Column:
    """ISO 7064 remainder of an account number; 1 confirms it."""
    plain = F.replace(match, F.lit(" "))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), lambda r, c: (
        F.when(c >= "A", r * 100).otherwise(r * 10) + value(c)) % 97)


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: let(
            F.ltrim(part, F.lit("0")), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))))
    if kind == "card":
        return let(digits(match), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match) == 1
    return F.lit(True)


def score(kind: str, before: Column, after: Column) -> Column:
    """The kind's score, 0.2 more with a telling word nearby, 0.3 less with a contrary one."""
    _, _, start, good, bad = KINDS[kind]
    near = F.lower(F.concat_ws(" ", F.right(before, F.lit(NEARBY)), F.left(after, F.lit(NEARBY))))
    some = lambda words: F.when(near.rlike(r"\b(?:" + "|".join(words) + ")"), 1.0).otherwise(0.0) if words else F.lit(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(start) + 0.2 * some(good) - 0.3 * some(bad))), 2)


def offsets(parts: Column) -> Column:
    """Start of every odd piece: sums over whole blocks of pieces, then within the block.

    Blocks of about the square root of the number of pieces keep the work far below its square.
    """
    lens = F.transform(parts, lambda p: F.length(p).cast("long"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, b: a + b)
    return let(lens, lambda ls: let(F.ceil(F.sqrt(F.size(ls))).cast("int"), lambda w: let(
        F.transform(F.sequence(F.lit(0), F.ceil(F.size(ls) / w).cast("int") - 1),
                    lambda b: total(F.slice(ls, b * w + 1, w))),
        lambda blocks: F.transform(
            F.sequence(F.lit(1), F.size(ls) - 2, F.lit(2)),
            lambda i: total(F.slice(blocks, F.lit(1), F.floor(i / w).cast("int")))
            + total(F.slice(ls, F.floor(i / w).cast("int") * w + 1, F.pmod(i, w)))))))


def find_spans(kind: str, text: Column) -> Column:
    """Confirmed spans ``start, end, score`` of one kind in a text without the mark, in order."""
    pattern, quick, *_ = KINDS[kind]
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    none = F.array().cast(SPAN)

    def spans(ps: Column) -> Column:
        found = F.transform(offsets(ps), lambda start, n: F.struct(
            start.alias("start"),
            (start + F.length(F.get(ps, 2 * n + 1))).alias("end"),
            F.when(confirmed(kind, F.get(ps, 2 * n + 1)), score(kind, F.get(ps, 2 * n), F.get(ps, 2 * n + 2))).alias("score")))
        return F.when(F.size(ps) < 3, none).otherwise(F.filter(found, lambda s: s["score"].isNotNull()).cast(SPAN))

    may = F.contains(text, F.lit(quick)) if quick == "@" else text.rlike(quick)
    return F.when(may, let(parts, spans)).otherwise(none)


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and one array of ``start, end, score`` per kind of ``KINDS``; offsets in code points, end exclusive.

    Matches of a kind are leftmost and do not overlap; those that fail their check are dropped and
    not tried again from within. Nearby words reach to the next match of the same kind at most. Null
    and empty texts have no spans; repeated rows are reported each; an empty table gives no rows.
    """
    clean = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    clean = F.when(F.contains(clean, F.lit(MARK)), F.replace(clean, F.lit(MARK), F.lit(STAND_IN))).otherwise(clean)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), clean.alias("_text"))
    return rows.select("doc_id", *[find_spans(kind, F.col("_text")).alias(kind) for kind in KINDS])


def joined(*kinds: str) -> Column:
    """``kind:start:end`` of all spans of the kinds, comma-joined."""
    def named(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*[named(kind) for kind in kinds]), ",")


def scores(*kinds: str) -> Column:
    """The scores of the same spans in the same order, comma-joined."""
    return F.array_join(F.concat(*[F.transform(F.col(kind), lambda s: F.format_string("%.2f", s["score"])) for kind in kinds]), ",")


def mask(text: Column, spans: Column, with_: str = "*") -> Column:
    """The text with each span of an ordered, disjoint array replaced by ``with_``."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    kept = F.transform(spans, lambda s, i: F.substr(text, (F.get(ends, i) + 1).cast("int"), (s["start"] - F.get(ends, i)).cast("int")))
    last = F.substr(text, (F.element_at(ends, -1) + 1).cast("int"))
    return F.array_join(F.concat(kept, F.array(last)), with_)
