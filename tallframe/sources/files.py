"""Files: listings, annotation CSV, waveforms, and stores of features and their descriptions."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallframe.operators import grid


def listing(spark: SparkSession, folder: str, *, select: str = ".*", remove: str | None = None, hidden: bool = False, glob: str = "*") -> DataFrame:
    """Files under a folder as ``path, stim``, those whose names match ``select`` and not ``remove``; names that begin with a dot are hidden."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    keep = name.rlike(select)
    if remove:
        keep &= ~name.rlike(remove)
    if not hidden:
        keep &= ~name.startswith(".")
    return files.select("path").where(keep).withColumn("stim", F.regexp_replace(name, r"\.[^.]*$", ""))


def read_csv(spark: SparkSession, path: str, schema: str, *, header_line: int = 0) -> DataFrame:
    """CSV files whose header is on the given line (0 is the first); lines above it are left out."""
    if header_line == 0:
        return spark.read.schema(schema).csv(path, header=True)
    lines = spark.read.text(path, wholetext=True)
    rows = lines.select(F.posexplode(F.split("value", r"\r?\n")).alias("k", "line")).where((F.col("k") > header_line) & (F.length("line") > 0))
    return rows.select(F.from_csv("line", F.lit(schema)).alias("r")).select("r.*")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation files of ``label, onset, duration`` as ``stim, label, onset, offset``."""
    rows = spark.read.schema("label string, onset double, duration double").csv(path, header=True)
    stim = F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1)
    return rows.select(stim.alias("stim"), "label", "onset", (F.col("onset") + F.col("duration")).alias("offset"))


def write_annotations(events: DataFrame, path: str) -> None:
    events.select("stim", "label", "onset", "offset").write.mode("overwrite").csv(path, header=True)


def read_wav(spark: SparkSession, path: str, *, channels: str = "mean") -> DataFrame:
    """WAV files as ``stim, sr, samples``: samples between -1 and 1, the mean of all channels, or the ``first``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, content in zip(f["path"], f["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    width, many = w.getsampwidth(), w.getnchannels()
                    raw = np.frombuffer(w.readframes(w.getnframes()), np.uint8).reshape(-1, many, width)
                    if width == 1:
                        x = raw[:, :, 0].astype(np.float64) / 128 - 1
                    else:  # little-endian, signed: shifted to the top of 32 bits
                        wide = np.zeros((len(raw), many, 4), np.uint8)
                        wide[:, :, 4 - width :] = raw
                        x = wide.view("<i4")[:, :, 0] / 2.0**31
                    rows.append((p.rsplit("/", 1)[-1][:-4], w.getframerate(), x.mean(axis=1) if channels == "mean" else x[:, 0]))
            yield pd.DataFrame(rows, columns=["stim", "sr", "samples"])

    return files.select("path", "content").mapInPandas(decode, "stim string, sr int, samples array<double>")


def encode_wav(waves: DataFrame) -> DataFrame:
    """Waveforms ``stim, sr, samples`` as ``stim, wav``, 16-bit mono files; samples beyond -1 to 1 raise an error rather than clip."""
    loud = F.exists("samples", lambda x: F.abs(x) > 1)
    checked = waves.select("stim", "sr", F.when(loud, F.raise_error(F.concat(F.lit("would clip: "), "stim"))).otherwise(F.col("samples")).alias("samples"))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for sr, x in zip(f["sr"], f["samples"], strict=True):
                with io.BytesIO() as b:
                    with wave.open(b, "wb") as w:
                        w.setparams((1, 2, int(sr), 0, "NONE", ""))
                        w.writeframes(np.clip(np.rint(np.asarray(x, float) * 32768), -32768, 32767).astype("<i2").tobytes())
                    out.append(b.getvalue())
            yield pd.DataFrame({"stim": f["stim"], "wav": out})

    return checked.mapInPandas(encode, "stim string, wav binary")


def write_features(features: DataFrame, path: str, *, feature: str, variant: str = "original", mode: str = "overwrite") -> None:
    """Writes ``stim, frame, ...`` below ``feature`` and ``variant``; Spark's commit makes the write whole or none."""
    features.write.mode(mode).parquet(f"{path}/feature={feature}/variant={variant}")


def replace_folder(spark: SparkSession, new: str, path: str) -> None:
    """Puts a folder that is whole in the place of another, if there is one, which stays beside it until then."""
    jvm = spark._jvm
    at, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(new)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(at.getParent())
    old = source.suffix(".old")
    if system.exists(at):
        system.rename(at, old)
    if not system.rename(source, at):
        system.rename(old, at)
        raise OSError(f"{new} can't be moved to {path}")
    system.delete(old, True)


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a write that ended."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def read_features(spark: SparkSession, path: str, feature: str, variant: str = "original") -> DataFrame:
    return spark.read.parquet(f"{path}/feature={feature}/variant={variant}")


def pca_variant(variant: str, k: int | None) -> str:
    """The name of a variant's first k components: ``pc100`` of ``original``, else with the variant's name before it."""
    return variant if k is None else f"pc{k}" if variant == "original" else f"{variant}_pc{k}"


def describe(spark: SparkSession, feature: str, variant: str, *, window: tuple[float, float], dimensions: str, sampling_rate: float, **parameters: object) -> DataFrame:
    """One row that describes a stored feature."""
    row = [(feature, variant, float(window[0]), float(window[1]), dimensions, float(sampling_rate), {k: str(v) for k, v in parameters.items()})]
    made = F.date_format(F.current_timestamp(), "yyyy-MM-dd-HH:mm:ss").alias("created")
    return spark.createDataFrame(row, "feature string, variant string, window_from double, window_to double, dimensions string, sampling_rate double, parameters map<string,string>").select("*", made)


def framed_wav(buffered: DataFrame, lengths: DataFrame, *, sr: int, target: int, front: int, back: int) -> tuple[DataFrame, DataFrame]:
    """Frames ``stim, frame, pos, x`` as WAV files, ``stim, frame, wav``, and their timing: ``stim, frame, start, onset, offset, end`` in seconds.

    Each file has ``front + target + back`` samples; what a frame lacks at an end is silence.
    """
    size = front + target + back
    known = F.map_from_entries(F.collect_list(F.struct(F.col("pos").cast("int"), F.col("x").cast("double"))))
    whole = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.try_element_at("_x", k), F.lit(0.0)))
    rows = buffered.groupBy("stim", "frame").agg(known.alias("_x")).select(F.to_json(F.struct("stim", "frame")).alias("stim"), F.lit(sr).alias("sr"), whole.alias("samples"))
    wavs = encode_wav(rows).select(F.from_json("stim", f"stim {buffered.schema['stim'].dataType.simpleString()}, frame bigint").alias("k"), "wav").select("k.stim", "k.frame", "wav")
    return wavs, frame_times(lengths, sr=sr, target=target, front=front, back=back)


def frame_times(lengths: DataFrame, *, sr: float, target: int, front: int, back: int) -> DataFrame:
    """``stim, frame, start, onset, offset, end`` in seconds from stimuli's lengths in samples."""
    at = F.col("frame") * F.lit(float(target))
    frames = lengths.where("length > 0").select("stim", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("length") / target).cast("bigint") - 1)).alias("frame"))
    times = {"start": at - front, "onset": at, "offset": at + target, "end": at + target + back}
    return frames.select("stim", "frame", *[(t / sr).alias(k) for k, t in times.items()])


def write_combined(buffered: DataFrame, path: str, *, feature: str, target: int, onset: int, variant: str = "original") -> None:
    """Stores the stimuli that their frames make up."""
    write_features(grid.combined(buffered, target, onset), path, feature=feature, variant=variant)


def frame_catalog(frames: DataFrame, *, first: int = 0) -> DataFrame:
    """``stim, frames``: how many frames each stimulus has from the first to the first gap; a stimulus without the first has 0."""
    own = frames.select("stim", "frame").distinct()
    behind = own.select("stim", (F.col("frame") + 1).alias("frame"))
    gaps = behind.join(own, ["stim", "frame"], "left_anti").where(F.col("frame") > first).groupBy("stim").agg(F.min("frame").alias("gap"))
    starts = own.groupBy("stim").agg(F.min("frame").alias("low"))
    return starts.join(gaps, "stim", "left").select("stim", F.when(F.col("low") == first, F.coalesce("gap", F.lit(first)) - first).otherwise(F.lit(0)).cast("bigint").alias("frames"))


def listed(spark: SparkSession, stims: str | None, folder: str, **options) -> DataFrame:
    """``listing`` of the named stimuli (comma-separated), or of all in order of their paths; a name that isn't there raises an error."""
    found = listing(spark, folder, **options)
    if not stims:
        return found.orderBy("path")
    names = [s.strip().removesuffix(".wav") for s in stims.split(",")]
    wanted = spark.createDataFrame(list(enumerate(names)), "ord int, stim string")
    known = found.join(F.broadcast(wanted), "stim").select("path", "stim", "ord").orderBy("ord").collect()  # as many as are named
    missing = set(names) - {r.stim for r in known}
    if missing:
        raise ValueError(f"no such stimulus: {', '.join(sorted(missing))}")
    return spark.createDataFrame([(r.path, r.stim) for r in known], "path string, stim string")
