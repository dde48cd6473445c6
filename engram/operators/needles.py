"""Many needles over many texts: one automaton per task, and equality of stretches for lengths that many needles have.

The needles that fit into one group of bounded size, rarest lengths first, are one automaton, which every part of the texts
meets in one task. The other lengths are few, each with many needles: a text is cut into its stretches of such a length
where one of its heads (the first characters of a needle) begins, and stretches equal to a needle are found by a join. Work
per text is its length times one more than these lengths, however many needles there are. No row per text and needle
exists unless the text has it; what is collected is one number per length of a needle.

A text has a needle if the lower-cased text contains the lower-cased needle; the characters ``%``, ``_`` and ``\\`` stand for
themselves. The empty needle is in every text that isn't null. Null texts and null needles meet nothing. Needles that
differ only in case are needles of their own. Rows that repeat are found each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Needles of a group, texts of a part.
GROUP_NEEDLES, PART_TEXTS = 50_000, 100_000
#: First characters of a needle that a stretch is looked at for, and how many such heads are told apart.
HEAD, HEADS = 6, 64


def _search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, needles, machine = None, defaultdict(list), None
    for frame in frames:
        found: list[tuple] = []
        for group, part, asks, row, text, said in frame[["group", "part", "asks", "id", "text", "said"]].itertuples(index=False):
            if now != (group, part):
                now, needles, machine = (group, part), defaultdict(list), None
            if not asks:
                needles[text].append(said)
                continue
            if machine is None:
                machine = ahocorasick.Automaton()
                for needle in filter(None, needles):
                    machine.add_word(needle, needle)
                if len(machine):
                    machine.make_automaton()
            hits = {n for _, n in machine.iter(text)} if len(machine) else set()
            found += [(row, said) for n in hits | ({""} & needles.keys()) for said in needles[n]]
        yield pd.DataFrame(found, columns=["id", "needle"])


def holding(texts: DataFrame, needles: DataFrame, group_needles: int = GROUP_NEEDLES, part_texts: int = PART_TEXTS) -> DataFrame:
    """``id, needle`` for every row of ``texts`` (id, text) and every distinct row of ``needles`` (needle) that it contains."""
    kind = texts.schema["id"].dataType.simpleString()
    texts, needles = texts.select("id", "text").filter("text IS NOT NULL"), needles.select("needle").filter("needle IS NOT NULL").distinct()
    lower = needles.withColumn("sought", F.lower("needle"))
    counted = sorted((r.asDict() for r in lower.groupBy(F.length("sought").alias("length")).count().collect()), key=lambda r: (r["count"], r["length"]))
    room, few, many = group_needles, [], []
    for r in counted:
        (few if r["count"] <= room else many).append(r["length"])
        room -= r["count"]
    if 0 in many:
        many.remove(0)
        few.append(0)
    found = [_by_stretches(texts, lower.filter(F.length("sought") == size), size) for size in many]
    if few or not many:
        found.append(_by_automaton(texts, lower.filter(F.length("sought").isin(few)).select("needle") if many else needles, kind, part_texts))
    return reduce(DataFrame.union, found)


def _by_stretches(texts: DataFrame, lower: DataFrame, size: int) -> DataFrame:
    """Needles of one length: each distinct stretch of a row's text of that length that begins like a needle, joined by equality."""
    low = texts.select("id", F.lower("text").alias("low")).filter(F.length("low") >= size)
    heads = [r[0] for r in lower.select(F.substring("sought", 1, min(size, HEAD)).alias("head")).distinct().limit(HEADS + 1).collect()]
    at = F.sequence(F.lit(1), F.length("low") - size + 1)
    if len(heads) > HEADS:  # too many to look for: every stretch
        stretches = F.transform(at, lambda k: F.substring(F.col("low"), k, F.lit(size)))
    else:
        low = low.filter(reduce(Column.__or__, [F.contains("low", F.lit(h)) for h in heads]))
        begins = lambda k: F.substring(F.col("low"), k, F.lit(min(size, HEAD))).isin(heads)
        stretches = F.transform(F.filter(at, begins), lambda k: F.substring(F.col("low"), k, F.lit(size)))
    return low.select("id", F.explode(F.array_distinct(stretches)).alias("sought")).join(lower, "sought").select("id", "needle")


def _by_automaton(texts: DataFrame, needles: DataFrame, kind: str, part_texts: int) -> DataFrame:
    """Needles of one group: a part of the texts in each task."""
    groups = 1
    parts = max(1, -(-texts.count() // part_texts))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    hosts = needles.select(F.pmod(F.xxhash64("needle"), F.lit(groups)).cast("int").alias("group"), upto(parts).alias("part"), F.lit(False).alias("asks"), F.lit(None).cast(kind).alias("id"), F.lower("needle").alias("text"), F.col("needle").alias("said"))
    guests = texts.select(upto(groups).alias("group"), F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int").alias("part"), F.lit(True).alias("asks"), "id", F.lower("text").alias("text"), F.lit("").alias("said"))
    told = hosts.union(guests).repartition("group", "part").sortWithinPartitions("group", "part", "asks")
    return told.mapInPandas(_search, f"id {kind}, needle string")
