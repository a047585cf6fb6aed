"""Settings with their defaults; the environment (CAIRNFLOW_<NAME>) and the session (cairnflow.<name>) override them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    store_path: str = ""
    destination_path: str = "."
    input_paths: tuple[str, ...] = ()
    algorithm: str = "sha256"
    quick: bool = False
    quick_check: bool = False
    use_cache: str = "true"
    overwrite: bool = False
    memory_layer: bool = False
    show_similar: bool = False
    similar_depth: int = 3
    digits: int = 7
    use_mirror: bool = False
    mirror_path: str = ""
    link_large_results: int = 1_000_000
    verbose: int = 1
    touches: bool = False
    resampling: str = "near"


def _typed(value: str, like):
    if isinstance(like, bool):
        return value.strip().lower() in ("1", "true", "yes")
    if isinstance(like, int):
        return int(value)
    if isinstance(like, tuple):
        return tuple(v for v in value.split(os.pathsep) if v)
    return value


def options(spark=None, **given) -> Options:
    base, found = Options(), {}
    for f in fields(Options):
        default = getattr(base, f.name)
        if (text := os.environ.get(f"CAIRNFLOW_{f.name.upper()}")) is not None:
            found[f.name] = _typed(text, default)
        if spark is not None and (text := spark.conf.get(f"cairnflow.{f.name}", None)) is not None:
            found[f.name] = _typed(text, default)
    return replace(base, **(found | given))
