"""Writers by file extension, and names for what is written."""

from __future__ import annotations

import os
import pickle
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.operators.conform import Data, Features, Raster


def file_name(name: str | bool | None, like: str = "", folder: str = ".", prefix: str = "Small") -> str | None:
    """The path to write to: relative names lie in ``folder``; True makes a name from ``like``; None doesn't write."""
    if name is None or name is False:
        return None
    if name is True:
        name = f"{prefix}{os.path.basename(like) or uuid.uuid4().hex}"
    return name if os.path.isabs(name) or "://" in name else os.path.join(folder, name)


def write_ascii_grid(raster: Raster, path: str, nodata: float = -9999.0) -> None:
    """Rows are made where their cells are, then put in order in one file."""
    g = raster.grid
    head = [f"ncols {g.ncol}", f"nrows {g.nrow}", f"xllcorner {g.extent.xmin!r}", f"yllcorner {g.extent.ymin!r}", f"cellsize {g.xres!r}", f"NODATA_value {nodata:g}"]
    text = F.coalesce(F.col("value").cast("string"), F.lit(f"{nodata:g}"))
    rows = raster.cells.where("layer = 0").groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", text.alias("t")))), lambda x: x["t"]), " ").alias("line"))
    lines = rows.orderBy("row").select("line")
    with open(path, "w") as file:
        file.write("\n".join(head) + "\n")
        for row in lines.toLocalIterator():
            file.write(row.line + "\n")


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    mode = "overwrite" if overwrite else "errorifexists"
    kind = os.path.splitext(path)[1].lstrip(".").lower() or "parquet"
    writer = df.write.mode(mode)
    if kind in ("csv", "tsv"):
        writer.csv(path, header=True, sep="," if kind == "csv" else "\t")
    elif kind in ("json", "jsonl"):
        writer.json(path)
    elif kind == "orc":
        writer.orc(path)
    elif kind == "xml":
        writer.format("xml").option("rowTag", "row").save(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"no writer for .{kind}")


def write_data(data: Data, path: str, overwrite: bool = False) -> str:
    """A raster as a text grid (.asc) or its cells as a table; features as a table."""
    if isinstance(data, Raster) and path.endswith(".asc"):
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(path)
        write_ascii_grid(data, path)
    else:
        write_table(data.cells if isinstance(data, Raster) else data.rows, path, overwrite)
    return path


def write_pickle(value, path: str, overwrite: bool = False) -> str:
    with open(path, "wb" if overwrite else "xb") as file:
        pickle.dump(value, file)
    return path


def is_features(data: Data) -> bool:
    return isinstance(data, Features)
