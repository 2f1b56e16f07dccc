"""The codec and container kernels under SQL names: Arrow UDFs, table functions and a grouped aggregate.

A payload that can't be read gives null (or no rows), never an error of the job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.kernels import container, lossless, lossy, package, signal


def _each(make):
    def run(x: pd.Series) -> pd.Series:
        out = []
        for v in x:
            try:
                out.append(None if v is None else make(bytes(v)))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run


def _samples(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[: len(raw) // 2 * 2], "<i2")


SCALAR = {
    "encode_lossless": lambda b: lossless.encode(_samples(b)),
    "decode_lossless": lambda b: lossless.decode(b).astype("<i2").tobytes(),
    "encode_lossy": lambda b: lossy.encode(_samples(b)),
    "decode_lossy": lambda b: lossy.decode(b).astype("<i2").tobytes(),
    "encode_hybrid": lambda b: lossy.encode_hybrid(_samples(b)),
    "decode_hybrid": lambda b: lossy.decode_hybrid(b).astype("<i2").tobytes(),
}


class ParseContainer:
    """A row per chunk of a container."""

    def eval(self, data: bytes):
        if data is None:
            return
        try:
            for c in container.index(lambda at, n: bytes(data[at : at + n]), len(data)):
                yield c.fourcc, c.repeat, len(c.payload) if c.payload is not None else None, c.payload
        except ValueError:
            return


class SplitFragments:
    """A row per fragment of a track's bytes."""

    def eval(self, track: str, data: bytes, most: int):
        for k, f in enumerate(package.split(track, bytes(data), most)) if data is not None else ():
            yield k, f


def register(spark: SparkSession) -> list[str]:
    """Registers all of them with the session; returns their names."""
    for name, make in SCALAR.items():
        spark.udf.register(name, F.pandas_udf(_each(make), "binary"))

    def snr_db(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else float(signal.snr(signal.to_float(_samples(bytes(x))), signal.to_float(_samples(bytes(y))))) for x, y in zip(a, b, strict=True)], dtype=float)

    def reassemble(fragments: pd.Series) -> bytes:
        read = [package.read_fragment(bytes(f)) for f in fragments if f is not None]
        return None if not read or None in read else package.joined(read)[0]

    spark.udf.register("snr_db", F.pandas_udf(snr_db, "double"))
    spark.udf.register("reassemble_fragments", F.pandas_udf(reassemble, "binary", F.PandasUDFType.GROUPED_AGG))
    spark.udtf.register("parse_container", F.udtf(ParseContainer, returnType="fourcc string, repeat int, size long, payload binary"))
    spark.udtf.register("split_fragments", F.udtf(SplitFragments, returnType="part int, fragment binary"))
    return [*SCALAR, "snr_db", "reassemble_fragments", "parse_container", "split_fragments"]
