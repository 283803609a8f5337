"""Operators on score documents: export lines, expected notes, split proposals, comparison in order of time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns that put plan_lines() in order within a document.
LINE_ORDER = ["section", "a", "b", "c"]


def plan_lines(meta: DataFrame, measures: DataFrame, events: DataFrame, all_voices: bool = False) -> DataFrame:
    """Tab-separated lines of each document's plan: document, LINE_ORDER, line.

    meta: document, title, tempo, tuning (array); measures: document, measure, number, numerator, denominator; events:
    document, measure, voice, position, onset_n, onset_d, value, dot, division, state, notes, pick. The lines are PLAN with
    the version, META of title (Base64), tempo and tuning, MEASURE, and EVENT. Version 2, of one voice, has each measure
    followed by its events. Version 3, with all_voices, has all measures, then the events voice by voice, with the voice
    after the place in the measure; strokes belong to the first voice only, others have 0.
    """

    def lines(df: DataFrame, section: int, a, b, c, *fields) -> DataFrame:
        at = [F.lit(x).cast("long") if isinstance(x, int) else F.col(x).cast("long") for x in (a, b, c)]
        said = [F.coalesce(F.col(f).cast("string"), F.lit("")) if isinstance(f, str) else f for f in fields]
        return df.select("document", F.lit(section).alias("section"), *[x.alias(n) for x, n in zip(at, "abc", strict=True)], F.concat_ws("\t", *said).alias("line"))

    word = F.lit
    out = [
        lines(meta, 0, 0, 0, 0, word("PLAN"), word("3" if all_voices else "2")),
        lines(meta, 1, 0, 0, 0, word("META"), word("TITLE_B64"), F.base64(F.encode("title", "UTF-8"))),
        lines(meta, 1, 1, 0, 0, word("META"), word("TEMPO"), "tempo"),
        lines(meta, 1, 2, 0, 0, word("META"), word("TUNING"), F.array_join(F.col("tuning").cast("array<string>"), ",")),
        lines(measures, 2, "measure", 0 if all_voices else -1, 0, word("MEASURE"), "measure", "number", "numerator", "denominator"),
    ]
    rest = ["onset_n", "onset_d", "value", "dot", "division", "state", "notes"]
    if all_voices:
        first = events.groupBy("document").agg(F.min("voice").alias("_first"))
        events = events.join(first, "document").withColumn("pick", F.when(F.col("voice") == F.col("_first"), F.col("pick")).otherwise(0))
        out.append(lines(events, 3, "voice", "measure", "position", word("EVENT"), "measure", "position", "voice", *rest, "pick"))
    else:
        out.append(lines(events, 2, "measure", "position", 0, word("EVENT"), "measure", "position", *rest, "pick"))
    return reduce(DataFrame.unionByName, out)


def expected_notes(geometry: DataFrame, semantic: DataFrame, beat: list[str], order: list[str]) -> DataFrame:
    """What each event should show: beat columns, notes (`string:fret`, or `string:X` for a dead note, sorted and joined by
    commas), and missing, the notes that the semantic beat lacks.

    geometry has beat, voice, string, fret, tied; tied notes are not shown. semantic has beat, voice, string, fret, dead; of
    several notes on one string and fret the last in `order` counts. An event with tied notes only has no row.
    """
    place = [*beat, "voice", "string", "fret"]
    known = semantic.groupBy(*place).agg(F.max_by("dead", F.struct(*order)).alias("dead"))
    shown = geometry.where("NOT tied").select(*place).distinct().join(known, place, "left")
    said = F.concat(F.col("string").cast("string"), F.lit(":"), F.when(F.col("dead"), "X").otherwise(F.col("fret").cast("string")))
    notes = F.array_join(F.array_sort(F.collect_set(F.when(F.col("dead").isNotNull(), said))), ",")
    return shown.groupBy(*beat).agg(notes.alias("notes"), F.count_if(F.col("dead").isNull()).alias("missing"))


def prune_split_proposals(events: DataFrame, by: list[str], order: list[str], x: str, spacing: Column) -> tuple[DataFrame, DataFrame]:
    """(events that stay with position and new_position, removed and changed groups by `by`).

    An event goes if the next of the original order is a matched attack more than 0 and at most 0.9 spacings after it, it
    is not matched itself, has only continued notes or none, and has no notes, a string in common with that attack, or a
    tie probability under 0.5. events has matched, strings (array), ties_only, tie; a null tie counts as 0.
    """
    w = W.partitionBy(*by).orderBy(*order)
    gap, none = F.lead(x).over(w) - F.col(x), F.size("strings") == 0
    close = F.coalesce(F.lead("matched").over(w) & (gap > 0) & (gap <= 0.9 * spacing), F.lit(False))
    doubtful = none | F.coalesce(F.arrays_overlap("strings", F.lead("strings").over(w)), F.lit(False)) | (F.coalesce("tie", F.lit(0.0)) < 0.5)
    marked = events.withColumn("position", (F.row_number().over(w) - 1).cast("long")).withColumn("_gone", ~F.col("matched") & (none | F.col("ties_only")) & close & doubtful)
    kept = marked.where("NOT _gone").drop("_gone").withColumn("new_position", (F.row_number().over(W.partitionBy(*by).orderBy("position")) - 1).cast("long"))
    return kept, marked.groupBy(*by).agg(F.count_if("_gone").alias("removed")).where("removed > 0")


def chronological_diff(expected: DataFrame, actual: DataFrame, by: list[str], order: list[str], index: str, fields: list[str]) -> DataFrame:
    """Where actual is not as expected: by, index, field, expected, found (as strings).

    expected is in any order: it is sorted within each group first, and numbered from 0 to meet actual's index. A group of
    unlike sizes has a row of the field 'count' without index; fields are compared where both sides have the row.
    """
    numbered = expected.withColumn(index, (F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    size = lambda df, n: df.groupBy(*by).agg(F.count(F.lit(1)).alias(n))
    text = lambda c: F.col(c).cast("string")
    counts = size(expected, "_e").join(size(actual, "_f"), by, "full").na.fill(0, ["_e", "_f"]).where("_e <> _f")
    counts = counts.select(*by, F.lit(None).cast("long").alias(index), F.lit("count").alias("field"), text("_e").alias("expected"), text("_f").alias("found"))
    other = actual.select(*by, index, *[F.col(c).alias(f"_{c}") for c in fields])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), text(c).alias("expected"), text(f"_{c}").alias("found")) for c in fields])
    wrong = F.filter(pairs, lambda p: ~p["expected"].eqNullSafe(p["found"]))
    return counts.unionByName(numbered.join(other, [*by, index]).select(*by, index, F.explode(wrong).alias("w")).select(*by, index, "w.*"))
