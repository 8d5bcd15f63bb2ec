"""The registry of models and the run over their graph."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Model(NamedTuple):
    name: str
    refs: tuple[str, ...]
    make: Callable[..., DataFrame]


MODELS: dict[str, Model] = {}


def model(*refs: str):
    """Register a function as the model of its name, made from what refs name."""

    def register(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        MODELS[make.__name__] = Model(make.__name__, refs, make)
        return make

    return register


class Frames(dict):
    """Frames by name: inputs (raw tables, seeds, as_of), and models, each made when first asked for. An unknown name is an error."""

    def __init__(self, inputs: dict, readers: dict[str, Callable[[], DataFrame]] | None = None) -> None:
        super().__init__(inputs)
        self.readers = readers or {}

    def __missing__(self, name: str):
        if name in self.readers:
            self[name] = self.readers[name]()
        elif name in MODELS:
            self[name] = MODELS[name].make(*(self[r] for r in MODELS[name].refs))
        else:
            raise KeyError(f"no input and no model is named {name}")
        return self[name]


def build(frames: Frames) -> Frames:
    """All models: each asks for those it is made from."""
    for name in MODELS:
        frames[name]
    return frames


def publish(spark: SparkSession, frames: dict[str, DataFrame], folder: str) -> dict:
    """Write frames under a new build and add its manifest last: readers take the latest manifest, so they see the old build or the new one, never half of one."""
    began, build_id = time.time(), uuid.uuid4().hex
    for name, df in frames.items():
        df.write.parquet(f"{folder}/{build_id}/{name}")
    manifest = {"at": time.time_ns(), "build": build_id, "tables": sorted(frames), "seconds": round(time.time() - began, 1)}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("append").text(f"{folder}/manifest")
    return manifest


def read_published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    manifest = max((json.loads(r[0]) for r in spark.read.text(f"{folder}/manifest").collect()), key=lambda m: m["at"])  # a row a build
    return spark.read.parquet(f"{folder}/{manifest['build']}/{name}")
