"""An assay: a set of DataFrames that share the columns assay, channel, time_idx and mark."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.session import current

SCHEMAS = {
    "tiles": "assay string, channel string, time_idx int, tile_row int, tile_col int, height int, width int, dtype string, px array<double>",
    "image": "assay string, channel string, time_idx int, y0 int, x0 int, height int, width int, px array<double>",
    "marks": "assay string, mark int, mark_row int, mark_col int, time_idx int, x double, y double, radius double, score double, tag string, valid boolean",
    "roi": "assay string, mark int, channel string, time_idx int, top int, left int, side int, px array<double>",
    "masks": "assay string, mark int, time_idx int, fg array<boolean>, bg array<boolean>",
    "ln": "assay string, mark int, ln string, vol double, ratio double",
    "dims": "assay string, dim string, idx int, label string, extra map<string,string>",
}
CANONICAL = ("channel", "time", "tile_row", "tile_col", "tile_y", "tile_x")
SHORT = {"y": "tile_y", "x": "tile_x", "row": "tile_row", "col": "tile_col"}


@dataclass(frozen=True)
class Assay:
    """tables: name -> DataFrame as in SCHEMAS; attrs: free-form, driver side."""

    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    attrs: Mapping[str, object] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        try:
            return self.tables[name]
        except KeyError:
            raise AttributeError(f"the assay has no table {name!r}") from None

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def with_(self, **tables: DataFrame) -> Assay:
        return replace(self, tables={**self.tables, **tables})

    def without(self, *names: str) -> Assay:
        return replace(self, tables={k: v for k, v in self.tables.items() if k not in names})

    def noting(self, **attrs: object) -> Assay:
        return replace(self, attrs={**self.attrs, **attrs})

    def map(self, name: str, change: Callable[[DataFrame], DataFrame]) -> Assay:
        return self.with_(**{name: change(self[name])})

    def cache(self, names: str | Sequence[str] | None = None) -> Assay:
        """Keep the named tables (all by default) on disk; lost parts are computed again from their lineage."""
        chosen = list(self.tables) if names is None else [names] if isinstance(names, str) else list(names)
        return self.with_(**{n: self[n].persist(StorageLevel.DISK_ONLY) for n in chosen})

    @property
    def names(self) -> list[str]:
        return [r[0] for r in self["dims"].select("assay").distinct().orderBy("assay").collect()]

    def one(self, name: str) -> Assay:
        return self.with_(**{k: v.filter(F.col("assay") == name) for k, v in self.tables.items()}).noting(name=name)


def table(name: str, rows: pd.DataFrame | Sequence[tuple] = ()) -> DataFrame:
    return current().createDataFrame(rows, SCHEMAS[name])


def from_numpy(array: np.ndarray, dims: Sequence[str], coords: Mapping[str, Sequence] | None = None, assay: str = "") -> Assay:
    """Tiles of an array in memory, one row per page. Short names are taken (y, x, row, col); unknown dims go into time, in order."""
    array, coords = np.asarray(array), dict(coords or {})
    original = tuple(dims)
    if len(original) != array.ndim:
        raise ValueError("dims must name every axis of the array")
    names = [SHORT.get(d, d) for d in original]
    if not {"tile_y", "tile_x"} <= set(names):
        raise ValueError("an array needs the dims y and x")
    extra = [d for d in names if d not in CANONICAL]
    order = [*(["channel"] if "channel" in names else []), *(["time"] if "time" in names else []), *extra, *[d for d in CANONICAL[2:] if d in names]]
    pages = array.transpose([names.index(d) for d in order])
    size = dict(zip(order, pages.shape))
    n_time = int(np.prod([size[d] for d in ("time", *extra) if d in size], dtype=int))
    shape = (size.get("channel", 1), n_time, size.get("tile_row", 1), size.get("tile_col", 1), size["tile_y"], size["tile_x"])
    pages = pages.reshape(shape)
    coords = {SHORT.get(k, k): list(map(str, v)) for k, v in coords.items()}
    channels = coords.get("channel", [str(i) for i in range(shape[0])])
    times = coords.get("time", [str(i) for i in range(n_time)]) if not extra else [str(i) for i in range(n_time)]
    rows = [
        (assay, channels[c], t, r, k, shape[4], shape[5], str(array.dtype), pages[c, t, r, k].astype(np.float64).ravel().tolist())
        for c in range(shape[0]) for t in range(n_time) for r in range(shape[2]) for k in range(shape[3])
    ]
    dims_rows = [(assay, "channel", i, c, {}) for i, c in enumerate(channels)] + [(assay, "time", i, t, {}) for i, t in enumerate(times)]
    return Assay(
        {"tiles": table("tiles", pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMAS["tiles"].split(", ")])), "dims": table("dims", dims_rows)},
        {"name": assay, "original_dims": original, "sizes": dict(zip(original, array.shape))},
    )


def plane(blocks: pd.DataFrame) -> np.ndarray:
    """One image from its blocks (y0, x0, height, width, px)."""
    h, w = int((blocks["y0"] + blocks["height"]).max()), int((blocks["x0"] + blocks["width"]).max())
    out = np.zeros((h, w))
    for y, x, bh, bw, px in zip(blocks["y0"], blocks["x0"], blocks["height"], blocks["width"], blocks["px"]):
        out[y : y + bh, x : x + bw] = np.asarray(px, dtype=np.float64).reshape(bh, bw)
    return out


def image_array(assay: Assay, channel: str, time_idx: int = 0) -> np.ndarray:
    """For small images and tests: one plane on the driver."""
    return plane(assay["image"].filter((F.col("channel") == channel) & (F.col("time_idx") == time_idx)).toPandas())
