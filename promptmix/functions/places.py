"""Places of regular-expression matches, in code points, without a UDF: from the lengths of the matches and of the
pieces between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE = "array<struct<start:int,end:int,word:string>>"


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, word>> of the matches in order; ends are exclusive; empty for null."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    pairs = F.zip_with(between, matches, lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("word")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(PLACE).alias("out"))

    def step(held: Column, pair: Column) -> Column:
        begin = held["at"] + pair["gap"]
        end = begin + F.length(pair["word"])
        return F.struct(end.alias("at"), F.concat(held["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), pair["word"].alias("word")))).alias("out"))

    # Most texts have no match, and one look is cheaper than two cuts.
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda held: held["out"])).otherwise(F.array().cast(PLACE))
