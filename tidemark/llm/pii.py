"""Personal data, with Spark's own functions only.

Regular expressions propose spans, checksums (Luhn for cards, mod 97 for
international account numbers) and ranges confirm them, and words near a span
move its score.  The whole operator is one projection: no shuffle, no Python.

A span's place is not given by Spark's functions, but the pieces that
``split`` leaves and the pieces that ``regexp_extract_all`` finds alternate,
so running sums of their lengths (in code points) give it.

Kinds ``email``, ``ip``, ``card`` and ``phone`` are found leftmost first and
without overlap within a kind; a proposal that fails its check is dropped and
not tried again.  ``iban`` is a further kind that this operator adds.

Defined results: a null text is an empty one and has no spans (counts 0, digest of
the empty string); rows are independent, so repeated rows repeat their result; ids may be null; an empty table gives no rows;
very long texts are scanned whole (the time of one with very many spans grows with their square); other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import id_text

# Patterns say the same as the plain ones in the comment, but don't go back over long runs:
# a match that begins within a run of characters also begins at the run's start or where the last match ended (\G).
# email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
# ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
# card   [0-9]([\x20-]?[0-9])+
# phone  \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?![\x20-]{2})[0-9\x20-])*[0-9]",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
}
BASE = ("email", "ip", "card", "phone")
#: Base scores, and words that raise the score of a kind when they stand near.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("address", "host", "server"),
    "card": ("card", "visa", "payment", "credit"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("account", "bank", "iban"),
}
NEAR = 40


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Luhn's check over a string of digits: from the right every second digit is doubled, less 9 when over 9."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2))
    return F.aggregate(doubled, F.lit(0), lambda s, v: s + v) % 10 == 0


def mod97_ok(account: Column) -> Column:
    """Mod 97 of an account number with its first four signs at the end and letters as 10 to 35."""
    plain = F.regexp_replace(account, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))
    values = F.transform(
        F.split(turned, ""),
        lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55),
    )
    return F.aggregate(values, F.lit(0), lambda r, v: F.when(v > 9, r * 100 + v).otherwise(r * 10 + v) % 97) == 1


def confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(hit, r"\."),
            lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(256)) <= 255,
        )
    if kind == "card":
        d = digits_of(hit)
        return F.length(d).between(14, 19) & luhn_ok(d)
    if kind == "phone":
        return F.length(digits_of(hit)).between(10, 15)
    if kind == "iban":
        return mod97_ok(hit)
    return F.lit(True)


def proposals(text: Column, kind: str, order: int) -> Column:
    """array<struct<start,ord,kind,stop,hit>>: the confirmed matches of the kind's pattern, with code-point places."""
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,stop:int,hit:string>>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), stop.alias("stop"), x["hit"].alias("hit"))
        return F.struct(stop.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    likely = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind)
    found = F.when(F.size(hits) > 0, F.aggregate(pairs, begin, step)["found"]).otherwise(none)
    found = F.filter(found, lambda s: confirmed(kind, s["hit"]))
    return found if likely is None else F.when(likely, found).otherwise(none)


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and found: array<struct<start,ord,kind,stop,hit,score>> of confirmed spans by start, then kind."""
    out = id_text(df, id_col, text_col)
    kinds = list(PATTERNS)
    sure = [proposals(F.col("text"), k, i) for i, k in enumerate(kinds)]
    text = F.col("text")

    def scored(s: Column) -> Column:
        left = F.greatest(s["start"] - NEAR, F.lit(0))
        near = F.lower(F.concat_ws(" ", F.substring(text, left + 1, s["start"] - left), F.substring(text, s["stop"] + 1, F.lit(NEAR))))
        score = F.lit(0.0)
        for k in kinds:
            words = F.lit("(?<![a-z])(?:" + "|".join(CONTEXT[k]) + ")")
            score = F.when(s["kind"] == k, F.lit(PRIOR[k]) + F.when(F.regexp_like(near, words), 0.1).otherwise(0.0)).otherwise(score)
        return F.struct(*[s[n].alias(n) for n in ("start", "ord", "kind", "stop", "hit")], F.round(score, 2).alias("score"))

    return out.select("doc_id", "text", F.array_sort(F.concat(*sure)).alias("raw")).select(
        "doc_id", "text", F.transform("raw", scored).alias("found")
    )


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def digest(df: DataFrame) -> DataFrame:
    """Counts and digests of ``spans``."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    base = F.filter("found", lambda s: s["kind"] != "iban")
    return df.select(
        "doc_id",
        *[F.size(F.filter("found", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", shown), ",").alias("spans"),
        F.array_join(F.transform("found", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
