"""Comparisons of an original with its synthesis: over all filters, before and after, by class of statistic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallframe.operators import stats


def similarities(a: DataFrame, b: DataFrame, keys: list[str], bins: tuple[int, ...] = (20, 50)) -> DataFrame:
    """``bins``, the keys (a filter, a channel) and both measures of how alike the distributions of ``x`` are, for each number of bins."""
    out = None
    for n in bins:
        both = stats.js_divergence(a, b, keys, n).join(stats.bhattacharyya(a, b, keys, n), keys).withColumn("bins", F.lit(n))
        out = both if out is None else out.unionByName(both)
    return out


def before_and_after(target: DataFrame, before: DataFrame, after: DataFrame, keys: list[str], group: str, value: str = "value") -> DataFrame:
    """Mean absolute errors of two syntheses against the target by ``group``, and by how many dB the second is better."""
    t = target.select(*keys, group, F.col(value).alias("_t"))
    rows = t.join(before.select(*keys, F.col(value).alias("_b")), keys).join(after.select(*keys, F.col(value).alias("_a")), keys)
    errors = rows.groupBy(group).agg(F.avg(F.abs(F.col("_b") - F.col("_t"))).alias("before"), F.avg(F.abs(F.col("_a") - F.col("_t"))).alias("after"))
    return errors.withColumn("gain_db", F.when((F.col("before") > 0) & (F.col("after") > 0), 20 * F.log10(F.col("before") / F.col("after"))))


def class_ratios(target: DataFrame, synth: DataFrame, keys: list[str], bands: DataFrame, cutoff: float, group: str = "statistic", value: str = "value") -> DataFrame:
    """The ratio of energy to error in dB for each class of statistics, over the bands (``k, var``) of significant power."""
    kept = stats.significant(bands, cutoff).where("significant").select("k")
    rows = target.join(F.broadcast(kept), "k", "left_semi").join(synth.select(*keys, F.col(value).alias("_s")), keys)
    return stats.energy_ratio(rows, [group], value, "_s")


def filtered_correlation(filtered: DataFrame, offsets: list[int] | None = None) -> DataFrame:
    """``filter, i, j, r`` from ``stim, filter, n, channel, x``: correlations of channels' filtered envelopes, whose means are zero.

    Channels at the ``offsets`` from each other are paired, or all with i < j, over the times at which both have a value. The channels of a time, which are
    few, are one row; a task adds up a matrix of products for each filter, and what is shuffled after is a row for each pair and task.
    """
    kind, number = (filtered.schema[c].dataType.simpleString() for c in ("filter", "channel"))
    rows = filtered.where("x is not null").groupBy("stim", "filter", "n").agg(F.collect_list(F.struct("channel", F.col("x").cast("double").alias("x"))).alias("v"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, names = batch.column("v"), batch.column("filter").to_pylist()
            flat, offsets_ = lists.flatten(), lists.offsets.to_numpy()
            time = np.repeat(np.arange(len(lists)), np.diff(offsets_))
            channel, x = flat.field("channel").to_numpy(), flat.field("x").to_numpy()
            size = int(channel.max()) + 1
            for name in dict.fromkeys(names):
                own = np.array([n == name for n in names])
                mine = own[time]
                values, here = np.zeros((len(own), size)), np.zeros((len(own), size))
                values[time[mine], channel[mine]], here[time[mine], channel[mine]] = x[mine], 1.0
                made = np.stack([values.T @ values, (values**2).T @ here, here.T @ here])
                old = sums.get(name, np.zeros((3, 0, 0)))
                both = np.zeros((3, *[max(old.shape[1], size)] * 2))
                both[:, : old.shape[1], : old.shape[1]] += old
                both[:, :size, :size] += made
                sums[name] = both
        for name, (ab, aa, n) in sums.items():
            i, j = np.nonzero(n)
            kept = i < j if offsets is None else np.isin(j - i, offsets)
            i, j = i[kept], j[kept]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), schema.field("filter").type), pa.array(i).cast(schema.field("i").type), pa.array(j).cast(schema.field("j").type), pa.array(ab[i, j]), pa.array(aa[i, j]), pa.array(aa[j, i])], schema=schema)

    made = f"filter {kind}, i {number}, j {number}, ab double, aa double, bb double"
    schema = to_arrow_schema(T._parse_datatype_string(made))
    sums = rows.select("filter", "v").mapInArrow(add, made).groupBy("filter", "i", "j").agg(F.sum("ab").alias("ab"), F.sum("aa").alias("aa"), F.sum("bb").alias("bb"))
    return sums.select("filter", "i", "j", F.try_divide("ab", F.sqrt(F.col("aa") * F.col("bb"))).alias("r"))
