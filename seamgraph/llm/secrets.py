"""Secret scan: base patterns, and sliding-window entropy over candidate strings.

A candidate is a run of 20 or more of the characters A-Z a-z 0-9 + / _ = -. Its class is hex if all of
it is 0-9 and one case of a-f, else base64. A window of WIDTH characters slides over it; the counts of
the window's characters change by one in and one out at each step, and with them the sum of
f(count) = count * log2(count), kept in whole 2^-20 parts so that steps leave no rounding behind. The
window's Shannon entropy is log2(WIDTH) - sum / WIDTH. Windows at the class's threshold or above mark
the candidate; the span runs from the first such window to the end of the last one. Candidates that the
allow-list knows, and spans within a base span, are suppressed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, spans

#: kind: (pattern, group whose length counts, least length), in the order that breaks ties.
BASE = {
    "assign": (
        r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        12,
    ),
    # a run that is too short ends nothing else, so the least length may stand in the pattern
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 16),
}
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WIDTH = 20
#: Least entropy of a window, in bits.
LEAST = {"hex": 3.1, "base64": 3.75}
#: Candidates that match one of these are no secrets: words, numbers, UUIDs, rules and paths of words, samples.
ALLOWED = (
    r"^[A-Za-z_=-]+$",
    r"^[0-9_=+-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^/?([A-Za-z_-]{2,}[0-9]{0,4}/)+[A-Za-z_-]*[0-9]{0,4}$",
    r"(?i)example|sample|placeholder|changeme|xxxx|1234567890|abcdefgh",
)
_UNIT = 1 << 20


def part(count: int) -> int:
    """count * log2(count) in 2^-20 parts."""
    return round(count * math.log2(count) * _UNIT) if count else 0


def most_sum(bits: float) -> int:
    """The largest sum of parts at which a window's entropy is `bits` or more."""
    return math.floor(WIDTH * (math.log2(WIDTH) - bits) * _UNIT)


#: Counts of a window lie side by side in whole numbers, five bits each (WIDTH is below 32), twelve to a number.
_BITS, _EACH = 5, 12
_CELLS = -(-len(ALPHABET) // _EACH)


def _marked(found: Column, limit: Column) -> Column:
    """struct(first, last): where the first and last window at or under the limit start; first is -1 if none."""

    def place(c: Column) -> Column:
        """Where a character's count lies: the number's place, and one of the count there."""
        k = F.call_function("instr", F.lit(ALPHABET), c) - 1
        shift = ((k % _EACH) * _BITS).cast("int")
        return F.struct(F.floor(k / _EACH).cast("int").alias("cell"), shift.alias("shift"), F.call_function("shiftleft", F.lit(1).cast("long"), shift).alias("one"))

    codes = F.transform(F.split(found, ""), place)
    parts = F.array(*[F.lit(part(k)) for k in range(WIDTH + 2)])

    def slide(code: Column) -> Column:
        at = lambda k: F.element_at(code, k.cast("int"))
        f = lambda k: F.element_at(parts, k + 1)
        names = [f"n{k}" for k in range(_CELLS)]
        zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in names], F.lit(0).cast("long").alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

        def count(acc: Column, c: Column) -> Column:
            cell = F.coalesce(*[F.when(c["cell"] == k, acc[n]) for k, n in enumerate(names)])
            return F.call_function("shiftright", cell, c["shift"]).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")

        def step(acc: Column, i: Column) -> Column:
            """One character in and, past the first window, one out: two counts change, whatever the alphabet's size."""
            into, out = at(i), at(F.greatest(i - WIDTH, F.lit(1)))
            full = i > WIDTH
            same = full & (out["cell"] == into["cell"]) & (out["shift"] == into["shift"])
            n_in, n_out = count(acc, into), F.greatest(count(acc, out), F.lit(1))
            s = F.when(same, acc["s"]).otherwise(acc["s"] + f(n_in + 1) - f(n_in) + F.when(full, f(n_out - 1) - f(n_out)).otherwise(F.lit(0)))
            moved = lambda n, k: acc[n] + F.when(into["cell"] == k, into["one"]).otherwise(F.lit(0)) - F.when(full & (out["cell"] == k), out["one"]).otherwise(F.lit(0))
            hit = (i >= WIDTH) & (s <= limit)
            return F.struct(
                *[moved(n, k).alias(n) for k, n in enumerate(names)], s.alias("s"),
                F.when(hit & (acc["first"] < 0), i - WIDTH).otherwise(acc["first"]).alias("first"), F.when(hit, i - WIDTH).otherwise(acc["last"]).alias("last"),
            )

        return F.aggregate(F.sequence(F.lit(1), F.size(code)), zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return let(codes, slide)


def _base(text: Column, kind: str) -> Column:
    pattern, group, least = BASE[kind]
    found = spans(text, pattern, group)
    rank = list(BASE).index(kind)
    return F.transform(
        F.filter(found, lambda x: F.length(x["part"]) >= least),
        lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")),
    )


def _entropy(text: Column) -> Column:
    allowed = lambda x: F.greatest(*[x.rlike(p) for p in ALLOWED])
    found = F.filter(spans(text, CANDIDATE), lambda x: ~allowed(x["found"]))

    def mark(x: Column) -> Column:
        is_hex = x["found"].rlike("^([0-9a-f]+|[0-9A-F]+)$")
        limit = F.when(is_hex, F.lit(most_sum(LEAST["hex"]))).otherwise(F.lit(most_sum(LEAST["base64"])))
        return F.struct(x["start"].alias("start"), is_hex.alias("is_hex"), _marked(x["found"], limit).alias("m"))

    marked = F.filter(F.transform(found, mark), lambda x: x["m"]["first"] >= 0)
    return F.transform(marked, lambda x: F.struct(
        (x["start"] + x["m"]["first"]).alias("start"), F.lit(len(BASE)).alias("rank"), (x["start"] + x["m"]["last"] + WIDTH).alias("end"),
        F.when(x["is_hex"], "entropy_hex").otherwise("entropy_base64").alias("kind"),
    ))


def secret_scan(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, base, found), one row per document: arrays of (start, rank, end, kind) in the
    order of start, then kind; code points, end exclusive. base holds what the base patterns find, found
    these and the spans that entropy adds.

    Null and empty texts hold nothing; whole texts are scanned; repeated rows stay; an empty table gives an
    empty result; extra columns are ignored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[_base(text, k).alias(k) for k in BASE], _entropy(text).alias("entropy"))
    base = kinds.select("doc_id", F.sort_array(F.concat(*BASE)).alias("base"), "entropy")
    fresh = F.filter("entropy", lambda e: ~F.exists("base", lambda b: (b["start"] <= e["start"]) & (e["end"] <= b["end"])))
    return base.select("doc_id", "base", F.when(F.size("entropy") == 0, F.col("base")).otherwise(F.sort_array(F.concat("base", fresh))).alias("found"))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
