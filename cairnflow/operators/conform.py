"""Bring gridded or vector data to a target: crop, project, mask, crop again, write.

Each step has its own target, ``to`` by default; ``SKIP`` leaves a step out. The first crop is padded and spares the
projection what the last one would drop.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from cairnflow.functions.projections import LonLat, Projection
from cairnflow.operators import grid as g
from cairnflow.operators import vector as v
from cairnflow.operators.grid import Extent, Grid

SKIP = object()


@dataclass
class Raster:
    cells: DataFrame
    grid: Grid


@dataclass
class Features:
    rows: DataFrame
    projection: Projection


Data = Raster | Features


def _in(data: Data, projection: Projection) -> Extent | None:
    """The data's extent in a projection: the box of its border, brought there."""
    if isinstance(data, Features):
        return v.extent(v.project(data.rows, data.projection, projection))
    e, own = data.grid.extent, data.grid.projection
    if own == projection:
        return e
    spark = data.cells.sparkSession
    n = 20
    border = [(e.xmin + (e.xmax - e.xmin) * i / n, y) for i in range(n + 1) for y in (e.ymin, e.ymax)]
    border += [(x, e.ymin + (e.ymax - e.ymin) * i / n) for i in range(n + 1) for x in (e.xmin, e.xmax)]
    return v.extent(v.project(v.features(spark, [(0, v.polygon(border))]), own, projection))


def crop_to(data: Data, target: Data, padded: bool = False) -> Data:
    """Restrict to the target's extent; ``padded``: by two cells, or a tenth of a degree, more."""
    own = data.grid.projection if isinstance(data, Raster) else data.projection
    box = _in(target, own)
    if box is None:
        return Raster(*g.crop(data.cells, data.grid, Extent(0, 0, 0, 0))) if isinstance(data, Raster) else Features(data.rows.where("false"), own)
    if isinstance(data, Raster):
        return Raster(*g.crop(data.cells, data.grid, box, 2 if padded else 0))
    if padded:
        pad = 0.1 if isinstance(own, LonLat) else 0.01 * max(box.xmax - box.xmin, box.ymax - box.ymin)
        box = box.buffered(pad, pad)
    return Features(v.crop(data.rows, box), own)


def project_to(data: Data, target: Data | Projection, method: str | None = None) -> Data:
    """To the target's projection; a raster on a raster also takes its cells, on features it keeps its resolution."""
    if isinstance(data, Features):
        to = target.grid.projection if isinstance(target, Raster) else target.projection if isinstance(target, Features) else target
        return Features(v.project(data.rows, data.projection, to), to)
    if isinstance(target, Raster):
        new = replace(target.grid, names=data.grid.names, datatype=data.grid.datatype, levels=data.grid.levels, colours=data.grid.colours)
    else:
        to = target.projection if isinstance(target, Features) else target
        if to == data.grid.projection:
            return data
        box = _in(data, to)
        scale = ((box.xmax - box.xmin) * (box.ymax - box.ymin) / max(1, data.grid.nrow * data.grid.ncol)) ** 0.5
        ncol, nrow = max(1, round((box.xmax - box.xmin) / scale)), max(1, round((box.ymax - box.ymin) / scale))
        new = replace(data.grid, nrow=nrow, ncol=ncol, extent=box, projection=to)
    if new.same_cells(data.grid):
        return data
    method = method or (g.resampling_method(data.grid.datatype) if data.grid.datatype else "near")
    call = g.resample_bilinear if method == "bilinear" else g.resample_nearest
    return Raster(call(data.cells, data.grid, new), new)


def mask_to(data: Data, target: Data, touches: bool = False) -> Data:
    """Null outside the target; features are cut by the target's, and left as they are by a raster."""
    if isinstance(data, Raster):
        if isinstance(target, Raster):
            on_grid = target if target.grid.same_cells(data.grid) else project_to(target, Raster(data.cells, data.grid), "near")
            return Raster(g.mask(data.cells, on_grid.cells), data.grid)
        area = v.project(target.rows, target.projection, data.grid.projection)
        return Raster(v.mask_cells(data.cells, data.grid, area, touches), data.grid)
    if isinstance(target, Raster):
        return data
    return Features(v.intersect(data.rows, v.project(target.rows, target.projection, data.projection)), data.projection)


def fix_errors(data: Data) -> Data:
    return Features(v.repaired(data.rows), data.projection) if isinstance(data, Features) else data


def conform(data: Data, to: Data | None = None, crop=None, project=None, mask=None, write=None, overwrite: bool = False, method: str | None = None, touches: bool = False, **older) -> Data:
    """Padded crop, projection, mask, crop, write; each to its own target or ``to``, or not at all with ``SKIP``.

    Older names of arguments (``OLD_NAMES``) are taken too; other names are an error.
    """
    if older:
        if unknown := sorted(set(older) - {*OLD_NAMES, "use_sa_crs", "mask_with_rtm", "filename2"}):
            raise TypeError(f"conform has no argument {', '.join(unknown)}")
        new = {k: x for k, x in {"to": to, "crop": crop, "project": project, "mask": mask, "write": write}.items() if x is not None}
        return conform(data, overwrite=overwrite, method=method, touches=touches, **with_old_names(**older, **new))
    crop, project, mask = (to if x is None else None if x is SKIP else x for x in (crop, project, mask))
    kind = type(data)
    if crop is not None and not (kind is Features and crop is project):
        data = crop_to(data, crop, padded=True)
    if project is not None:
        data = project_to(data, project, method)
    if mask is not None:
        data = mask_to(data, mask, touches)
    if crop is not None:
        data = crop_to(data, crop)
    if write:
        from cairnflow.sources.writers import write_data

        write_data(data, write, overwrite)
    return data


def conform_all(items: dict[str, Data], **settings) -> dict[str, Data]:
    return {name: conform(data, **settings) for name, data in items.items()}


#: Older names of arguments, and the steps that they are the target of. Of two for one step the later one counts.
OLD_NAMES = {
    "study_area": ("crop", "mask"),
    "raster_to_match": ("crop", "project", "to"),
    "target_crs": ("project",),
}


def with_old_names(**given) -> dict:
    """Arguments of ``conform`` from older names; a name given anew wins.

    ``use_sa_crs``: True projects to the study area, False doesn't project. ``mask_with_rtm``: the raster is the mask.
    """
    if "filename2" in given:
        raise ValueError("filename2 is gone; give write")
    old = {k: x for k, x in given.items() if k in (*OLD_NAMES, "use_sa_crs", "mask_with_rtm") and x is not None}
    made = {step: old[name] for name, steps in OLD_NAMES.items() if name in old for step in steps}
    if "use_sa_crs" in old:
        made["project"] = old.get("study_area") if old["use_sa_crs"] else SKIP
    if old.get("mask_with_rtm"):
        made["mask"] = old.get("raster_to_match")
    return made | {k: x for k, x in given.items() if k not in (*OLD_NAMES, "use_sa_crs", "mask_with_rtm")}
