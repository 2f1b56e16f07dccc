"""How a decoded signal differs from its original, in one pass over overlapping tiles, so that one long file is many tasks.

Samples (interleaved, 16 bits) are dealt to tiles of their file; a tile also gets the last samples before it, its halo: one for differences, and as
many as the slowest filter takes to forget (e**-40 of what came before is left, less than a double shows). Each tile gives partial sums, and partial sums per piece of
the sliding windows; sums of tiles add up exactly to those of the file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.kernels.signal import one_pole
from tessera.operators.library import hiss_score

# Fixed values of the measures: quiet below so many dB of full scale; band edges in Hz and the least rate they are taken at; levels that count as nothing; gates.
QUIET_DB, EDGES, LEAST_RATE, FULL = -42.0, (120.0, 800.0, 4000.0), 8000, 32768.0
NOTHING, BEST = 1e-20, 120.0
GATE_SNR, GATE_NOISE = 6.0, 0.00015
#: Samples of a tile.
TILE = 1 << 16
SUMS = ["n", "signal", "error", "quiet_n", "quiet_signal", "quiet_error", "steps", "hf", "lf", "frames", "mid", "side", *[f"band_signal_{k}" for k in range(4)], *[f"band_error_{k}" for k in range(4)]]


def halo(rate: int) -> int:
    return int(np.ceil(40 / (2 * np.pi * EDGES[0] / max(rate, LEAST_RATE))))


def bands(x: np.ndarray, rate: int) -> list[np.ndarray]:
    """Four bands of a signal from rest, parted by one-pole filters in a cascade."""
    a = [np.exp(-2 * np.pi * hertz / max(rate, LEAST_RATE)) for hertz in EDGES]
    low = one_pole(x, a[0])
    rest = x - low
    middle = rest - one_pole(rest, a[1])
    slow = one_pole(middle, a[2])
    return [low, rest, middle, middle - 2 * slow]


def tile_sums(original: np.ndarray, decoded: np.ndarray, before: int, rate: int, channels: int) -> dict:
    """Sums over a tile's own samples, the first `before` being its halo."""
    o, d = original / FULL, decoded / FULL
    e = o - d
    own_o, own_e, n = o[before:], e[before:], len(o) - before
    frames = -(-n // channels)
    padded = np.zeros(frames * channels)
    padded[:n] = np.abs(own_o)
    quiet = np.repeat(padded.reshape(frames, channels).max(1) < 10 ** (QUIET_DB / 20), channels)[:n]
    steps = np.diff(e[max(before - 1, 0) :])
    out = {"n": n, "signal": (own_o**2).sum(), "error": (own_e**2).sum(), "quiet_n": int(quiet.sum()), "quiet_signal": (own_o[quiet] ** 2).sum(), "quiet_error": (own_e[quiet] ** 2).sum()}
    out |= {"steps": len(steps), "hf": (steps**2).sum(), "lf": (own_e[n - len(steps) :] ** 2).sum()}
    pairs = own_e[: n // channels * channels].reshape(-1, channels) if channels > 1 else np.zeros((0, 2))
    out |= {"frames": len(pairs), "mid": ((pairs[:, 0] + pairs[:, 1]) ** 2).sum() / 4, "side": ((pairs[:, 0] - pairs[:, 1]) ** 2).sum() / 4}
    for k, (s, x) in enumerate(zip(bands(o, rate), bands(e, rate), strict=True)):
        out |= {f"band_signal_{k}": (s[before:] ** 2).sum(), f"band_error_{k}": (x[before:] ** 2).sum()}
    size = np.abs(decoded[before:])
    return out | {"peak": np.abs(own_e).max(initial=0), "largest": float(size.max(initial=0)), "clipped": int((size >= 32767).sum()), "non_zero": int((size > 0).sum()), "sounds": int((own_o != 0).sum())}


FIELDS = [*SUMS, "peak", "largest", "clipped", "non_zero", "sounds"]


def tiled(samples: DataFrame, key: str, index: str, original: str, decoded: str, rate: int, channels: int, tile: int = TILE) -> DataFrame:
    """key, tile, first (index), before (samples of the halo), original, decoded (arrays): whole frames, and the halo of frames before them. One shuffle."""
    tile, back = max(1, tile // channels) * channels, -(-halo(rate) // channels) * channels
    at = F.col(index)
    own = F.floor(at / tile).cast("long")
    # the tiles whose halo the sample lies in: the next ones, as far as the halo reaches
    last = F.floor((at + back) / tile).cast("long")
    rows = samples.select(F.col(key).alias("key"), at.cast("long").alias("i"), F.col(original).cast("int").alias("o"), F.col(decoded).cast("int").alias("d"), F.explode(F.sequence(own, last)).alias("tile"))
    g = rows.groupBy("key", "tile").agg(F.array_sort(F.collect_list(F.struct("i", "o", "d"))).alias("s"), F.count_if(F.col("i") < F.col("tile") * tile).alias("before"))
    return g.where(F.size("s") > F.col("before")).select("key", "tile", F.col("s.i")[0].alias("first"), "before", F.col("s.o").alias("original"), F.col("s.d").alias("decoded"))


def artifacts(samples: DataFrame, key: str, index: str, original: str, decoded: str, rate: int, channels: int = 1, seconds: float = 1.0, tile: int = TILE) -> DataFrame:
    """Per file: the SNR, of quiet frames, of the worst window, by high and low frequencies, mid and side, four bands, peak, clipping and gates.

    samples: key, index (from 0, no gaps), original and decoded as 16-bit integers; a row that is repeated or null breaks its file's order and isn't allowed.
    A window is `seconds` long and begins at every quarter of itself, rounded down, wherever that falls; a file shorter than a window has one, all of it.
    """
    kind = samples.schema[key].dataType.simpleString()
    window = int(rate * seconds) * channels
    step = max(1, window // 4)
    whole, rest = divmod(window, step)
    schema = pa.schema([("key", pa.from_numpy_dtype(np.int64) if kind in ("bigint", "int") else pa.string()), *[(f, pa.float64()) for f in FIELDS], ("cells", pa.list_(pa.struct([("cell", pa.int64()), ("part", pa.int32()), ("s", pa.float64()), ("e", pa.float64()), ("n", pa.int64())])))])

    def cells(first: int, o: np.ndarray, e: np.ndarray) -> list[dict]:
        """Energies between the places at which windows begin or end: a step is cut in two where windows end inside it."""
        at = first + np.arange(len(o))
        number, part = at // step, (at % step >= rest).astype(int)
        ends = np.flatnonzero(np.diff(number * 2 + part)) + 1
        starts = np.concatenate(([0], ends))
        s2, e2 = np.add.reduceat(o * o, starts), np.add.reduceat(e * e, starts)
        size = np.diff(np.concatenate((starts, [len(o)])))
        return [{"cell": int(number[a]), "part": int(part[a]), "s": float(s), "e": float(x), "n": int(n)} for a, s, x, n in zip(starts, s2, e2, size, strict=True)]

    def run(batches):
        for b in batches:
            rows = []
            for name, first, before, *pair in zip(*(b.column(c) for c in ("key", "first", "before", "original", "decoded")), strict=True):
                o, d = (x.values.to_numpy(zero_copy_only=False).astype(np.float64) for x in pair)
                sums = tile_sums(o, d, skip := before.as_py(), rate, channels)
                rows.append({"key": name.as_py(), **{f: float(sums[f]) for f in FIELDS}, "cells": cells(first.as_py() + skip, o[skip:] / FULL, (o[skip:] - d[skip:]) / FULL)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    names = ", ".join(f"{f} double" for f in FIELDS)
    parts = tiled(samples, key, index, original, decoded, rate, channels, tile).mapInArrow(run, f"key {'long' if kind in ('bigint', 'int') else 'string'}, {names}, cells array<struct<cell:long,part:int,s:double,e:double,n:long>>")
    total = parts.groupBy("key").agg(*[F.sum(f).alias(f) for f in SUMS], *[F.max(f).alias(f) for f in ("peak", "largest")], *[F.sum(f).alias(f) for f in ("clipped", "non_zero", "sounds")])
    # each piece to the windows that hold it: a whole step to `whole` windows, its first part to the one that ends in it, too
    piece = parts.select("key", F.explode("cells").alias("c")).select("key", "c.*")
    held = F.sequence(F.greatest(F.lit(0).cast("long"), F.col("cell") - F.when(F.col("part") == 0, whole if rest else whole - 1).otherwise(whole - 1)), F.col("cell"))
    sums = piece.withColumn("w", F.explode(held)).groupBy("key", "w").agg(*[F.sum(c).alias(c) for c in ("s", "e", "n")]).where(F.col("n") == window)
    worst = sums.withColumn("snr", snr(F.col("s"), F.col("e"))).groupBy("key").agg(F.min("snr").alias("worst_snr"), (F.min_by("w", F.struct("snr", "w")) * step).alias("worst_start"))
    root = lambda s, n: F.when(n > 0, F.sqrt(s / n)).otherwise(0.0)
    q_noise = root(F.col("quiet_error"), F.col("quiet_n"))
    q_signal = root(F.col("quiet_signal"), F.col("quiet_n"))
    silent = (F.col("quiet_n") == 0) | (F.col("quiet_signal") < NOTHING)
    few = F.col("n") < 4
    lf = F.when(few, 0.0).otherwise(F.sqrt(F.col("lf") / F.col("n")))
    out = total.join(worst, "key", "left").select(
        F.col("key").alias(key), F.col("n").cast("long").alias("samples"), snr(F.col("signal"), F.col("error")).alias("full_snr_db"),
        F.when(silent, BEST).otherwise(snr(F.col("quiet_signal"), F.col("quiet_error"))).alias("quiet_snr_db"),
        F.when(silent, -BEST).otherwise(F.when(q_signal > 1e-12, 20 * F.log10(q_noise / q_signal)).otherwise(20 * F.log10(q_noise))).alias("quiet_noise_floor_db"),
        F.when(silent, 0.0).otherwise(q_noise).alias("noise_floor_rms"),
        F.when(few, 0.0).otherwise(root(F.col("hf"), F.col("n") - 1)).alias("hf_err_rms"), lf.alias("lf_err_rms"),
        (root(F.col("side"), F.col("frames")) if channels > 1 else F.lit(0.0)).alias("side_err_rms"), (root(F.col("mid"), F.col("frames")) if channels > 1 else lf).alias("mid_err_rms"),
        F.coalesce("worst_snr", snr(F.col("signal"), F.col("error"))).alias("worst_snr_db"), (F.floor(F.coalesce("worst_start", F.lit(0)) / channels) / rate).alias("worst_start_sec"),
        F.array(*[F.when(F.col(f"band_signal_{k}") > NOTHING, F.sqrt(F.col(f"band_error_{k}") / F.col(f"band_signal_{k}"))).otherwise(0.0) for k in range(4)]).alias("band_error_ratios"),
        F.col("peak").alias("peak_error"), F.col("clipped").cast("long").alias("clipped_samples"), F.col("largest").cast("int").alias("max_abs_decoded"), F.col("non_zero").cast("long").alias("non_zero_samples"), (F.col("sounds") == 0).alias("is_silence"),
    )
    still = (F.col("max_abs_decoded") <= 1) & (F.col("non_zero_samples") == 0)
    quiet = (F.col("quiet_snr_db") > GATE_SNR) | (F.col("noise_floor_rms") < GATE_NOISE)
    out = out.withColumns({"silence_gate": ~F.col("is_silence") | still, "quiet_gate": F.when(F.col("is_silence"), still).otherwise(quiet)})
    return out.withColumn("hiss_score", hiss_score(F.col("quiet_noise_floor_db"), F.col("hf_err_rms"), F.col("worst_snr_db")))


def snr(signal: Column, error: Column) -> Column:
    """Decibels of one sum of squares over another: 120 where the error is nothing."""
    return F.when(error < NOTHING, BEST).otherwise(10 * F.log10(F.greatest(signal, F.lit(1e-30)) / error))
