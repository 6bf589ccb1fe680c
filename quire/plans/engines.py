"""Engines that read pages or parts of them: what they ask for, and one copy of each in a worker.

An engine is a model that the user brings.  Its description travels with the
plan; the model itself is loaded in the worker that first needs it, once a
process, and later tasks of the process find it there.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Engine:
    """``load()`` gives an object with ``pages(frame)`` and, if it ``prefers_regions``, ``regions(frame)``.

    Both take a frame of crops (page, kind, x, y, w, h, dpi and, of regions,
    region) and return blocks: page, [region], ord, type, text and more, by
    ``schema``.  ``tallest`` is the height of a region, in points, that the
    engine reads reliably at once.
    """

    id: str
    load: Callable[[], object]
    schema: StructType | str
    dpi: float = 150.0
    prefers_regions: bool = False
    tallest: float = 260.0

    @property
    def by_region(self) -> str:
        """The name under which pages go that were read by regions."""
        return f"{self.id}-layout"


_held: dict[str, object] = {}
_lock = threading.Lock()


def held(engine: Engine) -> object:
    """This process's model of an engine, loaded when first asked for and by one caller alone."""
    with _lock:
        if engine.id not in _held:
            _held[engine.id] = engine.load()
        return _held[engine.id]


def release(engine_id: str | None = None) -> None:
    """Forget an engine's model, or all of them."""
    with _lock:
        for k in [engine_id] if engine_id else list(_held):
            _held.pop(k, None)


def reader(engine: Engine, part: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What ``mapInPandas`` runs: the engine's ``pages`` or ``regions`` of each batch of crops."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield getattr(held(engine), part)(frame.assign(dpi=engine.dpi))

    return run


def read_pages(pages: DataFrame, engine: Engine) -> DataFrame:
    """Blocks of whole pages (page, width, height)."""
    crop = pages.select("page", F.lit("page").alias("kind"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"))
    return crop.mapInPandas(reader(engine, "pages"), engine.schema)
