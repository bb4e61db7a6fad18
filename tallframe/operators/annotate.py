"""Encoders of labels: cleaning, rare and merged labels, attributes, impulses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tallframe.functions.columns import clean_label
from tallframe.operators import joins

#: The 39 phoneme labels.
PHONEMES = "AA AE AH AO AW AY B CH D DH EH ER EY F G HH IH IY JH K L M N NG OW OY P R S SH T TH UH UW V W Y Z ZH".split()


def cleaned(events: DataFrame, *, silence: str = "spn") -> DataFrame:
    """Drops silence (by its exact name, and null labels), then upper-cases labels and strips digits."""
    return events.where(F.col("label") != silence).withColumn("label", clean_label(F.col("label")))


def label_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("label").agg(F.count("*").alias("n"))


def rare_merged(events: DataFrame, least: int = 10, name: str = "LOWPROB") -> DataFrame:
    """Labels that occur fewer than ``least`` times become one.

    Labels of a thousandth of all events, of which there are a thousand at most, are told by broadcast and
    pass by; the others are joined with the rare labels.
    """
    counts = label_counts(events)
    total = counts.agg(F.sum("n").alias("total"))
    often = counts.crossJoin(F.broadcast(total)).where((F.col("n") >= least) & (F.col("n") * 1000 >= F.col("total"))).select("label")
    rare = counts.where(F.col("n") < least).select("label", F.lit(True).alias("_rare"))
    rest = events.join(F.broadcast(often), "label", "left_anti").join(rare, "label", "left")
    rest = rest.withColumn("label", F.when(F.col("_rare"), name).otherwise(F.col("label"))).select(*events.columns)
    return events.join(F.broadcast(often), "label", "left_semi").select(*events.columns).unionByName(rest)


def set_merged(events: DataFrame, labels: list[str], name: str = "MERGED") -> DataFrame:
    return events.withColumn("label", F.when(F.col("label").isin(labels), name).otherwise(F.col("label")))


def with_attributes(events: DataFrame, attributes: DataFrame) -> DataFrame:
    """Each event once for each attribute of its label, from a table ``label, attribute``."""
    return events.join(attributes, "label").drop("label").withColumnRenamed("attribute", "label").select(*events.columns)


def encode_options(*, least: int | None = None, merge: list[str] | None = None, attribute: bool = False) -> None:
    """The options exclude each other."""
    if sum((least is not None, merge is not None, attribute)) > 1:
        raise ValueError("choose one of least, merge and attribute")


def impulses(onsets: DataFrame, rate: float) -> DataFrame:
    """Onsets as intervals of two frames."""
    return onsets.withColumn("offset", F.col("onset") + F.lit(2.0 / rate))


def masked(notes: DataFrame, mask: Column) -> DataFrame:
    """The notes of a mask; a missing value counts as set."""
    return notes.where(F.coalesce(mask, F.lit(True)))


def vocabulary(events: DataFrame) -> DataFrame:
    """The distinct labels in order."""
    return events.select("label").distinct().orderBy("label")


def rare_counts(events: DataFrame, least: int = 10, name: str = "LOWPROB") -> DataFrame:
    """The counts of ``rare_merged`` from those of the labels: only counts are shuffled."""
    counts = label_counts(events)
    return counts.groupBy(F.when(F.col("n") < least, name).otherwise(F.col("label")).alias("label")).agg(F.sum("n").alias("n"))


def encoded(events: DataFrame, rate: float, labels: list[str], *, least: int | None = None, merge: list[str] | None = None, attributes: DataFrame | None = None, onset_only: bool = False) -> DataFrame:
    """``stim, frame`` and a column of 0 or 1 for each of the labels, after one of: rare labels merged, a set merged, attributes for labels."""
    encode_options(least=least, merge=merge, attribute=attributes is not None)
    if least is not None:
        events = rare_merged(events, least)
    if merge is not None:
        events = set_merged(events, merge)
    if attributes is not None:
        events = with_attributes(events, attributes)
    return joins.one_hot(joins.occupied(events, rate, onset_only=onset_only), labels)


def phonemes(events: DataFrame, rate: float, **options) -> DataFrame:
    """One-hot phonemes: cleaned labels, the 39 classes, and the merged ones where labels are merged."""
    more = ["LOWPROB"] if options.get("least") is not None else ["MERGED"] if options.get("merge") is not None else []
    own = [r.attribute for r in options["attributes"].select("attribute").distinct().orderBy("attribute").collect()] if options.get("attributes") is not None else PHONEMES + more
    return encoded(cleaned(events), rate, own, **options)


def words(events: DataFrame, rate: float, least: int, most: int = 10_000) -> DataFrame:
    """One-hot words that occur ``least`` times and one column for all rarer ones; more than ``most`` columns raise an error."""
    kept = [r.label for r in label_counts(events).where(F.col("n") >= least).orderBy("label").limit(most + 1).collect()]
    if len(kept) > most:
        raise ValueError(f"more than {most} words occur {least} times")
    return encoded(events, rate, [*kept, "LOWPROB"], least=least)


def combined(*sets: DataFrame) -> DataFrame:
    """Feature sets side by side: the frames of any, with 0 in the numeric columns of a set that lacks the frame; nulls that a set holds stay."""
    out = sets[0].withColumn("_0", F.lit(True))
    for k, s in enumerate(sets[1:], 1):
        out = out.join(s.withColumn(f"_{k}", F.lit(True)), ["stim", "frame"], "full")
    filled = {c: F.when(F.col(f"_{k}").isNull(), F.lit(0)).otherwise(F.col(c)).cast(s.schema[c].dataType) for k, s in enumerate(sets) for c in s.columns if c not in ("stim", "frame") and isinstance(s.schema[c].dataType, NumericType)}
    return out.withColumns(filled).drop(*[f"_{k}" for k in range(len(sets))])
