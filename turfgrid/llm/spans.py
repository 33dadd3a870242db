"""Places of regular-expression matches in whole texts, as array columns; DataFrame functions only.

The places come from what lies between the matches: a split by the same expression gives the gaps, and a
running sum of gap and match lengths gives the ends. Lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEFT = 48
_FOUND = "struct<start:bigint,end:bigint,text:string,left:string>"
#: Running sums append to arrays of this length, so their cost stays linear in the number of matches.
_STEP = 256


def add_matches(table: DataFrame, name: str, pattern: str, gate: Column) -> DataFrame:
    """Add `name`: array of (start, end, text, left) of all matches, leftmost first, not overlapping.

    `gate` is a cheap test that every text with a match passes. `left` is the end of what precedes a match,
    back to the match before. Empty matches must be impossible.
    """
    none = F.array().cast("array<string>")
    table = table.withColumn("__texts", F.when(gate, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    gaps = F.slice(F.split("text", pattern, -1), F.lit(1), F.size("__texts"))
    parts = F.transform(
        F.arrays_zip(gaps.alias("gap"), F.col("__texts").alias("text")),
        lambda z: F.struct((F.length(z["gap"]) + F.length(z["text"])).cast("bigint").alias("step"), F.length(z["text"]).cast("bigint").alias("size"), z["text"].alias("text"), F.right(z["gap"], F.lit(LEFT)).alias("left")),
    )
    empty = F.array().cast("array<struct<step:bigint,size:bigint,text:string,left:string>>")
    table = table.withColumn("__parts", F.when(F.size("__texts") > 0, parts).otherwise(empty))
    blocks = f"transform(sequence(0, (size(__parts) - 1) div {_STEP}), b -> slice(__parts, b * {_STEP} + 1, {_STEP}))"
    based = f"""aggregate({blocks},
        named_struct('at', 0L, 'all', cast(array() as array<struct<base:bigint,block:array<struct<step:bigint,size:bigint,text:string,left:string>>>>)),
        (a, x) -> named_struct('at', a.at + aggregate(x, 0L, (s, v) -> s + v.step), 'all', array_append(a.all, named_struct('base', a.at, 'block', x))),
        a -> a.all)"""
    placed = f"""flatten(transform({based}, z -> aggregate(z.block,
        named_struct('at', z.base, 'all', cast(array() as array<{_FOUND}>)),
        (a, v) -> named_struct('at', a.at + v.step, 'all', array_append(a.all, named_struct('start', a.at + v.step - v.size, 'end', a.at + v.step, 'text', v.text, 'left', v.left))),
        a -> a.all)))"""
    found = F.when(F.size("__parts") > 0, F.expr(placed)).otherwise(F.array().cast(f"array<{_FOUND}>"))
    return table.withColumn(name, found).drop("__texts", "__parts")


def of_kind(matches: Column, kind: int) -> Column:
    """(start, kind, end) of each match: sorts by start, then by the number of the kind."""
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def listing(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of sorted (start, kind, end), joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (start < s["end"]))
