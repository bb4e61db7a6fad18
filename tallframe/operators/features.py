"""A feature from its name to the store: settings, dispatch, reuse of what is stored, components fitted, stored and applied."""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallframe.operators import pca, shapes
from tallframe.sources import files


@dataclass(frozen=True)
class Settings:
    feature: str = ""
    variant: str = "original"
    root: str = ""
    out_sr: float = 100.0
    window_from: float = -1.0
    window_to: float = 1.0
    pc: int = 100
    pca_weights_from: str = ""
    compute_original: bool = True
    meta_only: bool = False
    overwrite: bool = False
    modulation_type: str = "tempmod"
    nonlin: str = "modulus"
    nfilts: int = 80


#: Sets of settings by name; a file or an override changes single ones.
PRESETS = {"default": {}, "toy": {"nfilts": 10, "pc": 5}, "slow": {"out_sr": 25.0}, "spectrogram": {"feature": "spectrogram", "pc": 0}}


def checked(values: dict[str, object]) -> dict[str, object]:
    """Known keys with values of their kind; a whole number may stand for another."""
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    for k, v in values.items():
        if k not in kinds:
            raise ValueError(f"unknown setting {k}; known are {', '.join(kinds)}")
        if type(v) is not kinds[k] and not (kinds[k] is float and type(v) is int):
            raise ValueError(f"{k} must be a {kinds[k].__name__}, not {v!r}")
    return {k: float(v) if kinds[k] is float else v for k, v in values.items()}


def composed(path: str, choices: dict[str, str]) -> dict[str, object]:
    """A TOML file's values over those of the files it names in ``defaults``: ``group/name`` is the file of that name in the folder ``group`` beside it, or the group's choice."""
    with open(path, "rb") as f:
        own = tomllib.load(f)
    out: dict[str, object] = {}
    for part in own.pop("defaults", []):
        group, _, name = part.rpartition("/")
        out |= composed(os.path.join(os.path.dirname(path), group, f"{choices.get(group, name)}.toml"), choices)
    return out | own


def settings(preset: str = "default", *paths: str, overrides: list[str] = ()) -> Settings:
    """A preset, then TOML files in order, each over those in its ``defaults``, then ``key=value`` overrides, each over what stands before it.

    An override whose key is a group of some file (a folder beside it) chooses that group's file instead: ``env=fast`` takes ``env/fast.toml``.
    """
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset}")
    known = {f.name: type(f.default) for f in fields(Settings)}
    parted = [(k.strip(), v.strip()) for k, v in (o.split("=", 1) for o in overrides)]
    choices = {k: v for k, v in parted if k not in known and any(os.path.isdir(os.path.join(os.path.dirname(p), k)) for p in paths)}
    made = replace(Settings(), **checked(PRESETS[preset]))
    for path in paths:
        made = replace(made, **checked(composed(path, choices)))
    for key, value in parted:
        if key not in choices:
            text = f'"{value}"' if known.get(key) is str and not value.startswith('"') else value
            made = replace(made, **checked(tomllib.loads(f"{key} = {text}")))
    return made


def stored(spark: SparkSession, root: str, feature: str, variant: str) -> DataFrame | None:
    """What the store holds of a variant, or none."""
    try:
        return files.read_features(spark, root, feature, variant)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def describe(spark: SparkSession, s: Settings, variant: str, dimensions: str) -> None:
    own = {k: v for k, v in asdict(s).items() if k not in ("feature", "variant")}
    row = files.describe(spark, s.feature, variant, window=(s.window_from, s.window_to), dimensions=dimensions, sampling_rate=s.out_sr, **own)
    row.write.mode("overwrite").parquet(f"{s.root}/metadata/feature={s.feature}/variant={variant}")


#: Settings that a stored feature depends on, and those that its components depend on besides.
ORIGINAL = ("feature", "variant", "out_sr", "window_from", "window_to", "modulation_type", "nonlin", "nfilts")
COMPONENTS = (*ORIGINAL, "pc", "pca_weights_from")


def signature(s: Settings, names: tuple[str, ...]) -> str:
    """A hash of settings, the same wherever they come from."""
    return hashlib.sha256(json.dumps({k: getattr(s, k) for k in names}, sort_keys=True).encode()).hexdigest()


def signed(s: Settings, variant: str) -> str:
    return f"{s.root}/signature/feature={s.feature}/variant={variant}"


def is_current(spark: SparkSession, s: Settings, variant: str, names: tuple[str, ...]) -> bool:
    """Whether the store holds the variant, whole, made with these settings."""
    try:
        row = spark.read.parquet(signed(s, variant)).first()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return row is not None and row.signature == signature(s, names) and stored(spark, s.root, s.feature, variant) is not None


def store(spark: SparkSession, made: DataFrame, s: Settings, variant: str, names: tuple[str, ...], dimensions: str) -> DataFrame:
    """Writes a feature beside the stored one, puts it in that one's place once it is whole, then its description and, last, its signature."""
    path = f"{s.root}/feature={s.feature}/variant={variant}"
    new = f"{s.root}/_new/{uuid.uuid4()}"
    made.write.parquet(new)
    files.replace_folder(spark, new, path)
    describe(spark, s, variant, dimensions)
    row = spark.createDataFrame([(signature(s, names), json.dumps({k: getattr(s, k) for k in names}, sort_keys=True))], "signature string, settings string")
    row.write.mode("overwrite").parquet(signed(s, variant))
    return files.read_features(spark, s.root, s.feature, variant)


def compute(spark: SparkSession, s: Settings, registry: dict[str, Callable[[SparkSession, Settings], DataFrame]]) -> DataFrame | None:
    """The feature ``stim, frame, v`` of the settings, computed and stored, or read where it is stored with these settings already.

    What is stored with other settings, or wasn't stored whole, is computed anew. ``overwrite`` computes it in any case; without ``compute_original`` it
    must be stored with these settings; ``meta_only`` writes the description alone. With ``pc`` its first components are fitted (or read from
    ``pca_weights_from``), applied and stored too. A stored feature stays until its successor is whole; what was read before must be read again.
    """
    if s.feature not in registry:
        raise ValueError(f"unknown feature {s.feature}; known are {', '.join(sorted(registry))}")
    if s.meta_only:
        describe(spark, s, s.variant, "time, feature")
        return None
    current = is_current(spark, s, s.variant, ORIGINAL)
    if not current and not s.compute_original:
        raise ValueError(f"{s.feature} isn't stored with these settings and isn't to be computed")
    again = not current or (s.overwrite and s.compute_original)
    if again:
        store(spark, registry[s.feature](spark, s), s, s.variant, ORIGINAL, "time, feature")
    original = files.read_features(spark, s.root, s.feature, s.variant)
    if s.pc and (again or s.overwrite or not is_current(spark, s, files.pca_variant(s.variant, s.pc), COMPONENTS)):
        model = load_components(spark, s.pca_weights_from) if s.pca_weights_from else fit_components(original, f"{s.root}/weights/feature={s.feature}/variant={s.variant}")
        apply_components(original, model, s)
    return original


def fit_components(features: DataFrame, path: str, *, stimuli: list | None = None, frames: int | None = None, **options: bool) -> DataFrame:
    """Components of features (of some stimuli, of their first frames), stored as a model table and read again."""
    own = features if stimuli is None else features.where(F.col("stim").isin(stimuli))
    own = own if frames is None else shapes.truncated(own, frames)
    pca.fit(own, **options).write.mode("overwrite").parquet(path)
    return load_components(features.sparkSession, path)


def load_components(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """A stored model, or its first k components."""
    model = spark.read.parquet(path)
    return model if k is None else model.where(F.col("k") < k)


def apply_components(features: DataFrame, model: DataFrame, s: Settings) -> DataFrame:
    """Scores of all stimuli at once, stored with a description. Stimuli are rows of one table: none is concatenated or split."""
    return store(features.sparkSession, pca.project(features, model, s.pc), s, files.pca_variant(s.variant, s.pc), COMPONENTS, "time, component")


def of_stimulus(features: DataFrame, stim: object) -> DataFrame:
    """One stimulus's part of features that hold all."""
    return features.where(F.col("stim") == F.lit(stim))


def layered(features: DataFrame, root: str, steps: list[tuple[Callable[[DataFrame], DataFrame], int]], **options: bool) -> DataFrame:
    """Components of components: each step makes features from the scores before it and keeps its own first k, models stored by layer."""
    now = features
    for layer, (make, k) in enumerate(steps):
        made = make(now)
        now = pca.project(made, fit_components(made, f"{root}/layer={layer}", **options), k)
    return now
