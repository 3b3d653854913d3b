"""Image and mask files as rows: decoding, encoding, containers, and a data source for both."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, WriterCommitMessage

from . import formats as fm

RASTER = "width int, height int, channels int, depth string, data binary"


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content); a query without content does not read it."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def decode(data: bytes, path: str = "") -> np.ndarray:
    """An image by its extension, or else its first byte, as (h, w, c) or (h, w)."""
    ext = path.lower().rpartition(".")[2]
    if ext in ("tif", "tiff") or data[:1] in (b"I", b"M"):
        return fm.tiff_decode(data)
    if ext == "gif" or data[:3] == b"GIF":
        return fm.gif_decode(data)
    return fm.png_decode(data)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, channels, depth, data) of the files that Spark's `image` source decodes: JPEG among others; bands in the order R, G, B, A."""

    @F.pandas_udf("binary")
    def ordered(data: pd.Series, channels: pd.Series) -> pd.Series:
        flip = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}
        return pd.Series([np.frombuffer(d, np.uint8).reshape(-1, c)[:, flip[c]].tobytes() for d, c in zip(data, channels, strict=True)])

    found = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return found.select(F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), F.lit("uint8").alias("depth"), ordered("data", "nChannels").alias("data"))


def _raster(image: np.ndarray | None) -> tuple:
    if image is None:
        return (None,) * 5
    return image.shape[1], image.shape[0], 1 if image.ndim == 2 else image.shape[2], image.dtype.name, image.astype(image.dtype.newbyteorder("<")).tobytes()


def decode_images(files: DataFrame, permissive: bool = False) -> DataFrame:
    """files (path, content) with width, height, channels, depth and data (interleaved, little endian).

    permissive: nulls where a file cannot be read, instead of an error.
    """
    keep = [c for c in files.columns if c != "content"]
    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append(_raster(decode(bytes(content), path)))
                except Exception:
                    if not permissive:
                        raise
                    rows.append(_raster(None))
            made = pd.DataFrame(rows, columns=["width", "height", "channels", "depth", "data"])
            for c in ("width", "height", "channels"):
                made[c] = made[c].astype("Int32")
            yield pd.concat([pdf[keep].reset_index(drop=True), made], axis=1)

    return files.mapInPandas(run, f"{schema}, {RASTER}")


def to_8bit(rasters: DataFrame) -> DataFrame:
    """16-bit rasters as 8-bit ones by 255/65535, half to even; 8-bit ones as they are."""

    @F.pandas_udf("binary")
    def scale(data: pd.Series, depth: pd.Series) -> pd.Series:
        return pd.Series([np.rint(np.frombuffer(d, "<u2") * (255 / 65535)).astype(np.uint8).tobytes() if k == "uint16" else d for d, k in zip(data, depth, strict=True)])

    return rasters.withColumn("data", scale("data", "depth")).withColumn("depth", F.lit("uint8"))


def pixels(rasters: DataFrame, key: str) -> DataFrame:
    """(key, x, y, px): one row for each pixel, px an array of channel values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, w, h, c, depth, data in zip(pdf[key], pdf["width"], pdf["height"], pdf["channels"], pdf["depth"], pdf["data"], strict=True):
                image = np.frombuffer(data, np.dtype(depth).newbyteorder("<")).reshape(-1, c)
                yield pd.DataFrame({key: k, "x": np.tile(np.arange(w, dtype=np.int32), h), "y": np.repeat(np.arange(h, dtype=np.int32), w), "px": list(image.astype(np.int32))})

    kind = rasters.schema[key].dataType.simpleString()
    return rasters.select(key, "width", "height", "channels", "depth", "data").mapInPandas(run, f"`{key}` {kind}, x int, y int, px array<int>")


def arrays(px: DataFrame, values: list[str], width: int, height: int, key: str = "image_id") -> DataFrame:
    """(key, data): each image as one flat array, row after row, pixel after pixel, the values of a pixel side by side.

    Missing pixels are 0. Numpy takes it by reshape(height, width, len(values)).
    """
    at = (F.col("y").cast("long") * width + F.col("x")).alias("at")
    own = px.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).select(key, at, F.array(*values).alias("v"))
    held = own.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("held"))
    blank = F.array(*[F.lit(0) for _ in values])
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(width * height - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("held", i), blank))
    return held.select(key, F.flatten(cells).alias("data"))


def images(px: DataFrame, encode: Callable[[np.ndarray], bytes], key: str = "image_id", size: tuple[int, int] | None = None, depth: str = "uint8") -> DataFrame:
    """(key, content): dense pixels (key, x, y, v) encoded, one group for each image; its size is (width, height), or where pixels end."""

    def run(k, pdf):
        w, h = size or (pdf["x"].max() + 1, pdf["y"].max() + 1)
        image = np.zeros((h, w), dtype=depth)
        image[pdf["y"], pdf["x"]] = pdf["v"]
        return pd.DataFrame({key: [k[0]], "content": [encode(image)]})

    return px.select(key, "x", "y", "v").groupBy(key).applyInPandas(run, f"{key} {px.schema[key].dataType.simpleString()}, content binary")


def encode_png(px: DataFrame, level: int = -1, key: str = "image_id", size: tuple[int, int] | None = None) -> DataFrame:
    return images(px, lambda image: fm.png_encode(image, level), key, size)


def encode_png_raw(rasters: DataFrame, level: int = -1) -> DataFrame:
    """Rows with width, height, channels and data (interleaved bytes) with `content`, a PNG; an error where data has another length."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, w: pd.Series, h: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([fm.png_encode_raw(bytes(d), int(i), int(j), int(k), level) for d, i, j, k in zip(data, w, h, c, strict=True)])

    return rasters.withColumn("content", run("data", "width", "height", "channels"))


MASK_DUMPS = {"bits": fm.bitmask_dump, "tree": fm.treemask_dump, "mapped": fm.mappedmask_dump}


def dump_masks(mask: DataFrame, width: int, height: int, kind: str = "tree") -> DataFrame:
    """(mask_id, content): masks (mask_id, x, y) in a file format, bits, tree or mapped."""
    dump = MASK_DUMPS[kind]

    def run(k, pdf):
        m = np.zeros((height, width), dtype=bool)
        m[pdf["y"], pdf["x"]] = True
        return pd.DataFrame({"mask_id": [k[0]], "content": [dump(m)]})

    return mask.select("mask_id", "x", "y").groupBy("mask_id").applyInPandas(run, f"mask_id {mask.schema['mask_id'].dataType.simpleString()}, content binary")


def mask_leaves(files: DataFrame, most_depth: int | None = None, extents: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(mask_id, x, y, size, white) leaves of tree or mapped files (mask_id, content); white null where cut at most_depth."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, content in zip(pdf["mask_id"], pdf["content"], strict=True):
                content = bytes(content)
                if content[:6] == fm.MAPPED_MAGIC:
                    rows = [(x, y, s, w) for _, x, y, s, w in fm.mappedmask_leaves(content, most_depth, extents)]
                else:
                    rows = fm.treemask_leaves(content)[1]
                out = pd.DataFrame(rows, columns=["x", "y", "size", "white"])
                out.insert(0, "mask_id", k)
                out["white"] = out["white"].astype("boolean")
                yield out

    return files.mapInPandas(run, f"mask_id {files.schema['mask_id'].dataType.simpleString()}, x int, y int, size int, white boolean")


def load_masks(files: DataFrame) -> DataFrame:
    """(mask_id, x, y): set pixels of masks in any of the formats. Mapped files tell no size: their whole square counts."""

    def load(content: bytes) -> np.ndarray:
        if content[:5] == fm.BIT_MAGIC:
            return fm.bitmask_load(content)
        if content[:5] == fm.TREE_MAGIC:
            return fm.treemask_load(content)
        leaves = fm.mappedmask_leaves(content)
        side = max((x + s for _, x, _, s, _ in leaves), default=0)
        m = np.zeros((side, side), dtype=bool)
        for _, x, y, s, white in leaves:
            m[y : y + s, x : x + s] = white
        return m

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, content in zip(pdf["mask_id"], pdf["content"], strict=True):
                y, x = np.nonzero(load(bytes(content)))
                yield pd.DataFrame({"mask_id": k, "x": x.astype(np.int32), "y": y.astype(np.int32)})

    return files.mapInPandas(run, f"mask_id {files.schema['mask_id'].dataType.simpleString()}, x int, y int")


def embedded_masks(files: DataFrame, permissive: bool = False) -> DataFrame:
    """files (path, content) with `mask`, the bytes of the mask that the image carries; null if there is none and permissive."""

    @F.pandas_udf("binary")
    def read(content: pd.Series) -> pd.Series:
        out = []
        for c in content:
            try:
                out.append(fm.embedded_mask_read(bytes(c)))
            except Exception:
                if not permissive:
                    raise
                out.append(None)
        return pd.Series(out)

    return files.withColumn("mask", read("content"))


def embed_masks(files: DataFrame, mask: str = "mask") -> DataFrame:
    """files (content, mask) with the mask put into content."""

    @F.pandas_udf("binary")
    def write(content: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([fm.embedded_mask_write(bytes(c), bytes(x)) for c, x in zip(content, m, strict=True)])

    return files.withColumn("content", write("content", F.col(mask)))


# ------------------------------------------------------------------ data source


class ContainerSource(DataSource):
    """`format("tiff_container")`: the files inside TIFF containers, as (path, name, content), one partition for each container.

    Reads the paths of the option `path` (comma separated, or a folder); writes rows (path, name, content), each
    container at its path by one task, so rows of one path should lie in one partition.
    """

    @classmethod
    def name(cls) -> str:
        return "tiff_container"

    def schema(self) -> str:
        return "path string, name string, content binary"

    def reader(self, schema):
        return ContainerReader(self.options)

    def writer(self, schema, overwrite):
        return ContainerWriter()


class ContainerReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path", "")

    def partitions(self):
        import glob
        import os

        from pyspark.sql.datasource import InputPartition

        found = []
        for p in self.path.split(","):
            p = p.removeprefix("file://").removeprefix("file:")
            found += sorted(glob.glob(os.path.join(p, "*.tif*"))) if os.path.isdir(p) else [p]
        return [InputPartition(p) for p in found]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            data = f.read()
        for name, content in fm.container_items(data):
            yield partition.value, name, content


class FileMessage(WriterCommitMessage):
    """What a task has written: (temporary name, name) of each file."""

    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class FileWriter(DataSourceWriter):
    """Whole files under names of their own, renamed when all tasks are done and removed if the job fails.

    A task that runs again, or twice at once, leaves nothing half written at the final path.
    """

    def contents(self, iterator) -> Iterator[tuple[str, bytes]]:
        raise NotImplementedError

    def write(self, iterator):
        import uuid

        done = []
        for path, content in self.contents(iterator):
            temporary = f"{path}.{uuid.uuid4().hex}.part"
            with open(temporary, "wb") as f:
                f.write(content)
            done.append((temporary, path))
        return FileMessage(done)

    def commit(self, messages):
        import os

        files = [x for m in messages if m is not None for x in m.files]
        names = [path for _, path in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two tasks wrote one path: rows of one file must lie in one partition")
        for temporary, path in files:
            os.replace(temporary, path)

    def abort(self, messages):
        import contextlib
        import os

        for temporary, _ in [x for m in messages if m is not None for x in m.files]:
            with contextlib.suppress(FileNotFoundError):
                os.remove(temporary)


class ContainerWriter(FileWriter):
    def contents(self, iterator):
        held: dict[str, dict[str, bytes]] = {}
        for row in iterator:
            held.setdefault(row["path"], {})[row["name"]] = bytes(row["content"])
        for path, entries in held.items():
            yield path, fm.container_write(entries)


class ImageSink(DataSource):
    """`format("image_files")`: a sink that writes rows (path, content) as files, one each."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite):
        return ImageWriter()


class ImageWriter(FileWriter):
    def contents(self, iterator):
        for row in iterator:
            yield row["path"], bytes(row["content"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContainerSource)
    spark.dataSource.register(ImageSink)


def containers(entries: DataFrame) -> DataFrame:
    """(path, content): one TIFF container for each path of the entries (path, name, content), names in order."""

    def run(k, pdf):
        pdf = pdf.sort_values("name", kind="stable")
        return pd.DataFrame({"path": [k[0]], "content": [fm.container_write({n: bytes(c) for n, c in zip(pdf["name"], pdf["content"], strict=True)})]})

    return entries.select("path", "name", "content").groupBy("path").applyInPandas(run, "path string, content binary")


def container_entries(files: DataFrame) -> DataFrame:
    """(path, name, content): as the data source, over files that any Spark reader loaded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                held = list(fm.container_items(bytes(content)))
                yield pd.DataFrame({"path": path, "name": [n for n, _ in held], "content": [c for _, c in held]})

    return files.select("path", "content").mapInPandas(run, "path string, name string, content binary")
