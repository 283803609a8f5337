"""Chains of references: ids in lists that point to the rows of another table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hop(df: DataFrame, refs: str, target: DataFrame, ident: str, pos: str) -> tuple[DataFrame, DataFrame]:
    """(rows of df for each id in the blank-separated list refs, with its place and the columns of target; ids that target
    lacks, as the columns of df and `ref`).

    -1 and nothing between blanks are no references and take no place. An id that target has not gives no row. target has
    each id once; rows that share an id are split by adaptive execution if they are many.
    """
    ids = F.filter(F.split(F.coalesce(refs, F.lit("")), r"\s+"), lambda x: (x != "-1") & (x != ""))
    each = df.select("*", F.posexplode(ids).alias(pos, "_ref"))
    there = target.withColumn("_there", F.lit(True)).withColumnRenamed(ident, "_id")
    met = each.join(there, each["_ref"] == F.col("_id").cast("string"), "left")
    found = met.where("_there").drop("_ref", "_there").withColumnRenamed("_id", ident)
    return found, met.where("_there IS NULL").select(*df.columns, F.col("_ref").alias("ref"))


def resolve_bars(bars: DataFrame, voices: DataFrame, beats: DataFrame, notes: DataFrame, rhythms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, dangling) of bars whose lists lead over voices and beats to notes and a rhythm.

    bars: bar, voice_refs; voices: voice, beat_refs; beats: beat, note_refs, rhythm_ref; notes: note, said; rhythms: rhythm,
    ticks. An event is (bar, voice_number, position, beat, state, notes, ticks, onset): places count from 0 in the order of
    the lists; notes are what they say, in order, joined by commas; a beat without notes is a rest; onset is the sum of the
    ticks before it in its voice, and null ticks do not advance it. dangling is (hop, owner, ref): ids that point nowhere.
    An event with a dangling rhythm has null ticks; dangling notes are left out of it.
    """
    in_bar, no_voice = hop(bars, "voice_refs", voices, "voice", "voice_number")
    in_voice, no_beat = hop(in_bar.select("bar", "voice_number", "voice", "beat_refs"), "beat_refs", beats, "beat", "position")
    place = ["bar", "voice_number", "position", "beat"]
    # The lists of a beat are followed once for each beat, wherever it stands.
    sounds, no_note = hop(beats.select("beat", "note_refs"), "note_refs", notes, "note", "_n")
    chord = sounds.groupBy("beat").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "said"))), lambda x: x["said"]), ",").alias("notes"))
    timed, no_rhythm = hop(beats.select("beat", "rhythm_ref"), "rhythm_ref", rhythms, "rhythm", "_r")
    events = in_voice.select(*place).join(chord, "beat", "left").join(timed.select("beat", "ticks"), "beat", "left")
    before = F.coalesce(F.sum("ticks").over(W.partitionBy("bar", "voice_number").orderBy("position").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    events = events.select(*place, F.when(F.col("notes").isNull(), "rest").otherwise("note").alias("state"), F.coalesce("notes", F.lit("")).alias("notes"), "ticks", before.alias("onset"))
    owners = (("voice", no_voice, "bar"), ("beat", no_beat, "voice"), ("note", no_note, "beat"), ("rhythm", no_rhythm, "beat"))
    dangling = [d.select(F.lit(name).alias("hop"), F.col(owner).cast("string").alias("owner"), "ref") for name, d, owner in owners]
    return events, reduce(DataFrame.unionByName, dangling)
