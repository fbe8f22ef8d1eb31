"""Background segmentation of frames (camera_id, frame_no, v): trained in batch, run in batch or as a stream.

The model of a camera is the mean frame and its amplitude. Frames of a camera come in order; a stream drops frames that are
not newer than its state. Pixels are independent, so frames are cut into tiles and the state is that of a (camera, tile): a
camera of large frames is spread over tasks, and a task reads its tiles in order, holding one state at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec


@dataclass(frozen=True)
class Settings:
    """What the band is wider than the amplitude, and how fast background and foreground pixels are learnt."""

    zeta: float = 10.0
    background: float = 1 / 20
    foreground: float = 1 / 80


def frames_of_events(events: DataFrame, cameras: int = 8) -> DataFrame:
    """One-pixel frames: the values of a group of users in the order of time."""
    camera = (F.col("user_id") % cameras).alias("camera_id")
    order = Window.partitionBy("camera_id").orderBy("ts", "event_id")
    rows = events.select(camera, "ts", "event_id", "value")
    return rows.select("camera_id", (F.row_number().over(order) - 1).cast("bigint").alias("frame_no"), F.array("value").alias("v"))


def frame_vector(rows: int, cols: int, size: int = 320):
    """A kernel for `operators.image.vector_of`: the longest side to `size`, gray, smoothed, flat."""
    from ..operators import image

    scale = size / max(rows, cols)

    def run(a: np.ndarray) -> np.ndarray:
        small = image.resize(a, max(1, round(rows * scale)), max(1, round(cols * scale)))
        return image.gaussian5x5(image.gray(small)[:, :, None])

    return run


def clean_mask(mask: np.ndarray) -> np.ndarray:
    """A mask (rows, cols) eroded once and dilated six times."""
    from ..operators import image

    out = image.erode(mask[:, :, None].astype(float))
    for _ in range(6):
        out = image.dilate(out[:, :, None])
    return out


def train(frames: DataFrame) -> DataFrame:
    """(camera_id, mean, amplitude, frames): two aggregates over the pixels, summed up in the tasks first."""
    cells = frames.select("camera_id", F.posexplode("v").alias("n", "x"))
    means = cells.groupBy("camera_id", "n").agg(F.avg("x").alias("u"), F.count(F.lit(1)).alias("c"))
    spread = cells.join(means, ["camera_id", "n"]).groupBy("camera_id", "n").agg(F.first("u").alias("u"), F.first("c").alias("c"), F.avg(F.sqrt((F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) * 2.0)).alias("a"))
    cell = F.array_sort(F.collect_list(F.struct("n", "u", "a")))
    return spread.groupBy("camera_id").agg(cell.alias("p"), F.max("c").alias("frames")).select("camera_id", F.transform("p", lambda p: p["u"]).alias("mean"), F.transform("p", lambda p: p["a"]).alias("amplitude"), "frames")


def step(mean: np.ndarray, amplitude: np.ndarray, frame: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mask, mean, amplitude) after one frame: 1 where the pixel leaves the band around the mean.

    The mean follows background pixels alone; the amplitude follows both, foreground pixels more slowly.
    """
    inside = (mean - amplitude - s.zeta <= frame) & (frame <= mean + amplitude + s.zeta)
    spread = np.sqrt(2 * (frame - mean) ** 2)
    new = np.where(inside, mean + s.background * (frame - mean), mean)
    return (~inside).astype(int), new, amplitude + np.where(inside, s.background, s.foreground) * (spread - amplitude)


def cut(df: DataFrame, tile: int | None, *arrays: str) -> DataFrame:
    """`df` with a row for every `tile` elements of its arrays, numbered by `tile`; None leaves them whole."""
    if tile is None:
        return df.withColumn("tile", F.lit(0))
    last = F.greatest(F.ceil(F.size(arrays[0]) / tile).cast("int") - 1, F.lit(0))
    rows = df.withColumn("tile", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumns({c: F.slice(c, F.col("tile") * tile + 1, F.lit(tile)) for c in arrays})


def segment_tiles(frames: DataFrame, models: DataFrame, settings: Settings = Settings(), tile: int = 1024) -> DataFrame:
    """(camera_id, tile, frame_no, copy, mask): each tile's frames in order, its model kept up to date.

    Rows are sorted by (camera, tile, frame number) inside their partitions, the model's row first, and folded as they stream
    by: the length of a history costs no memory. Frames of one number come in the order of a hash of the whole frame, the
    same for all tiles, and `copy` counts them from 0. Frames without a camera, a number or a vector, and frames of a camera
    without a model, give no row.
    """
    whole = frames.filter("camera_id is not null and frame_no is not null and v is not null")
    whole = whole.select(F.col("camera_id").cast("bigint").alias("camera_id"), F.lit(1).alias("kind"), F.col("frame_no").cast("bigint").alias("frame_no"), F.xxhash64("v").alias("h"), "v", F.lit(None).cast("array<double>").alias("a"))
    known = models.filter("camera_id is not null and mean is not null").select(F.col("camera_id").cast("bigint").alias("camera_id"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("frame_no"), F.lit(0).cast("bigint").alias("h"), F.col("mean").alias("v"), F.col("amplitude").alias("a"))
    rows = cut(known, tile, "v", "a").unionByName(cut(whole, tile, "v"))
    rows = rows.repartition("camera_id", "tile").sortWithinPartitions("camera_id", "tile", "kind", "frame_no", "h")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = mean = amplitude = last = None
        copy = 0
        for batch in batches:
            out = []
            for camera, part, kind, number, v, a in zip(batch["camera_id"], batch["tile"], batch["kind"], batch["frame_no"], batch["v"], batch["a"]):
                v = np.asarray(v, float)
                if kind == 0:
                    key, mean, amplitude, last = (camera, part), v, np.asarray(a, float), None
                elif key == (camera, part):
                    copy, last = copy + 1 if number == last else 0, number
                    mask, mean, amplitude = step(mean, amplitude, v, settings)
                    out.append((camera, part, number, copy, mask))
            yield pd.DataFrame(out, columns=["camera_id", "tile", "frame_no", "copy", "mask"])

    own = rows.select("camera_id", "tile", "kind", "frame_no", "v", "a")
    return own.mapInPandas(run, "camera_id bigint, tile int, frame_no bigint, copy int, mask array<int>")


def segment(frames: DataFrame, models: DataFrame, settings: Settings = Settings(), tile: int = 1024) -> DataFrame:
    """(camera_id, frame_no, mask): the masks of `segment_tiles`, put together frame by frame."""
    parts = segment_tiles(frames, models, settings, tile)
    whole = parts.groupBy("camera_id", "frame_no", "copy").agg(F.array_sort(F.collect_list(F.struct("tile", "mask"))).alias("p"))
    return whole.select("camera_id", "frame_no", F.flatten(F.transform("p", lambda p: p["mask"])).alias("mask"))


def segment_stream(frames: DataFrame, models: dict[int, tuple[list[float], list[float]]], settings: Settings = Settings(), tile: int | None = None) -> DataFrame:
    """`segment` for a stream of frames: the state of a camera is its last frame number, mean and amplitude.

    `models` has the trained (mean, amplitude) of the cameras; one that is not there starts from its first frame. With `tile`
    the state is that of a (camera, tile), and rows are (camera_id, tile, frame_no, mask). A task holds what one
    micro-batch has of its camera or tile; the source's limits on a micro-batch bound it.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        camera, part = key
        if state.exists:
            last, mean, amplitude = state.get
            mean, amplitude = np.asarray(mean, float), np.asarray(amplitude, float)
        else:
            last, (mean, amplitude) = -1, (None, None)
            if camera in models:
                own = slice(None) if tile is None else slice(part * tile, (part + 1) * tile)
                mean, amplitude = (np.asarray(x, float)[own] for x in models[camera])
        out = []
        whole = pd.concat(list(batches)).sort_values("frame_no", kind="stable")
        for number, frame in zip(whole["frame_no"], whole["v"]):
            frame = np.asarray(frame, float)
            if number <= last:
                continue
            if mean is None:
                mean, amplitude = frame, np.zeros_like(frame)
            mask, mean, amplitude = step(mean, amplitude, frame, settings)
            last = int(number)
            out.append((camera, part, last, mask.tolist()))
        if mean is not None:
            state.update((last, mean.tolist(), amplitude.tolist()))
        yield pd.DataFrame(out, columns=["camera_id", "tile", "frame_no", "mask"])

    rows = cut(frames.select("camera_id", "frame_no", "v"), tile, "v")
    out = rows.groupBy("camera_id", "tile").applyInPandasWithState(run, "camera_id bigint, tile int, frame_no bigint, mask array<int>", "last bigint, mean array<double>, amplitude array<double>", "append", "NoTimeout")
    return out.drop("tile") if tile is None else out


def row_stream(spark, path: str) -> DataFrame:
    """A stream of vectors (v) from text files of one vector a line; header lines (`1 -1 n -1 -1`) are passed over."""
    lines = spark.readStream.text(path)
    parts = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    rows = lines.select(F.transform(parts, lambda x: x.cast("double")).alias("v"))
    return rows.filter((F.size("v") > 0) & ~((F.size("v") == 5) & (vec.element("v", 1) == -1) & (vec.element("v", 3) == -1)))
