"""Memoised calls: a call's key is the content of its function and arguments; its result is stored once and read after.

``memo(fn, *args, **kwargs)`` binds the arguments (with defaults) by name, hashes each, and looks the key up in one or
more stores. On a miss the function runs, the result is written, and what is returned is read from the store: every
later reader sees the same rows, whatever the plan's randomness.
"""

from __future__ import annotations

import contextvars
import datetime as dt
import functools
import inspect
import os
import threading
import time
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import PurePath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.functions import digest
from cairnflow.operators import tags as tag_ops
from cairnflow.options import options
from cairnflow.plans.store import CODECS, Store

_NESTED: contextvars.ContextVar[tuple] = contextvars.ContextVar("nested", default=())
_LOCKS: dict[tuple[str, str], threading.Lock] = {}
_GUARD = threading.Lock()
_POOL = ThreadPoolExecutor(max_workers=2)
_PENDING: list[Future] = []


@dataclass
class Result:
    """A value with what is known of its call."""

    value: Any
    cache_id: str
    is_new: bool
    key: dict[str, str] = field(default_factory=dict)
    similar: list[dict] = field(default_factory=list)
    arguments: dict[str, Any] | None = None


@functools.singledispatch
def tags_for(value) -> list[tuple[str, str]]:
    """More tags for a result, by its class: register to extend."""
    return []


@functools.singledispatch
def prepared(value):
    """The stored form of a result, by its class."""
    return value


def bound_arguments(fn: Callable, args: tuple, kwargs: Mapping, omit: Iterable[str] = ()) -> dict[str, Any]:
    """Arguments by name with defaults, without those to omit: all ways to write a call are one."""
    try:
        bound = inspect.signature(fn).bind(*args, **kwargs)
        bound.apply_defaults()
        named = dict(bound.arguments)
        for p in inspect.signature(fn).parameters.values():
            if p.kind is p.VAR_KEYWORD:
                named |= named.pop(p.name, {})
            elif p.kind is p.VAR_POSITIONAL:
                named |= {f"{p.name}[{k}]": x for k, x in enumerate(named.pop(p.name, ()))}
    except (TypeError, ValueError):
        named = {f"[{k}]": x for k, x in enumerate(args)} | dict(kwargs)
    gone = set(omit)
    return {k: x for k, x in named.items() if k not in gone}


def call_key(fn: Callable, args: tuple = (), kwargs: Mapping | None = None, *, omit: Iterable[str] = (), only: Mapping[str, Iterable[str]] | None = None, extra: Any = None, quick: Iterable[str] | bool = (), algorithm: str = "sha256", length: int | None = None, class_options: Mapping[type, Callable] | None = None) -> tuple[str, dict[str, str]]:
    """(key, hash by argument name).

    ``only``: for an argument that is a mapping, the members that count. ``quick``: arguments (or all) that are paths,
    told by name and size rather than content. ``length``: so many bytes of each file that is an argument count.
    ``class_options``: for a class, a function that gives what counts of its values.
    """
    named = bound_arguments(fn, args, kwargs or {}, omit)
    for name, members in (only or {}).items():
        if isinstance(named.get(name), Mapping):
            chosen = set(members)
            named[name] = {k: x for k, x in named[name].items() if k in chosen}
    hashes = {"function": digest.value_hash(fn, algorithm)}
    for name, x in named.items():
        of_class = next((make for kind, make in (class_options or {}).items() if isinstance(x, kind)), None)
        x = x if of_class is None else of_class(x)
        fast = quick is True or (quick is not False and name in set(quick))
        if length is not None and not fast and isinstance(x, PurePath) and os.path.isfile(x):
            hashes[name] = digest.file_hash(str(x), algorithm, length=length)
            continue
        hashes[name] = digest.text_hash(f"{digest.file_hash(str(x), quick=True)} {getattr(x, 'name', x)}", algorithm) if fast and hasattr(x, "name") and hasattr(x, "is_file") and x.is_file() else digest.value_hash(x, algorithm)
    if extra is not None:
        hashes["extra"] = digest.value_hash(extra, algorithm)
    return digest.arguments_hash(hashes, algorithm), hashes


def _lock(store: Store, key: str) -> threading.Lock:
    with _GUARD:
        return _LOCKS.setdefault((store.root, key), threading.Lock())


def _use_cache(text: str) -> bool | int | str:
    """The option's text as ``use_cache`` takes it."""
    plain = text.strip().lower()
    if plain in ("true", "false"):
        return plain == "true"
    return int(plain) if plain.isdigit() else text.strip()


def similar_calls(store: Store, hashes: Mapping[str, str], function_name: str, n: int = 1) -> list[dict]:
    """The stored calls of the function that share most argument hashes, and which arguments differ."""
    tags = store.tags()
    wanted = store.spark.createDataFrame([(f"preDigest:{k}", v) for k, v in hashes.items()], "tagKey string, tagValue string")
    own = tags.join(tag_ops.matching_ids(tags, function=[function_name]), "cacheId", "left_semi")
    best = tag_ops.most_similar(own, wanted)
    latest = own.join(best, "cacheId").groupBy("cacheId").agg(F.max("createdDate").alias("at"), F.max("n_shared").alias("n_shared")).orderBy(F.desc("at"), "cacheId").limit(n)
    found = []
    for row in latest.collect():
        report = tag_ops.differences(wanted, own, row.cacheId).where("status <> 'same'").collect()
        found.append({"cacheId": row.cacheId, "n_shared": row.n_shared, "differs": sorted(r.tagKey.removeprefix("preDigest:") for r in report)})
    return found


def memo(
    fn: Callable,
    *args,
    store: Store | list[Store] | None = None,
    user_tags: Iterable[str] = (),
    omit: Iterable[str] = (),
    only: Mapping[str, Iterable[str]] | None = None,
    extra: Any = None,
    function_name: str | None = None,
    use_cache: bool | int | str | None = None,
    cache_id: str | None = None,
    not_older_than: dt.datetime | None = None,
    show_similar: bool | None = None,
    quick: Iterable[str] | bool | None = None,
    mirror: Store | None = None,
    in_memory: bool | None = None,
    output_columns: Iterable[str] | None = None,
    wait: bool = True,
    digest_only: bool = False,
    link_result: bool = True,
    algorithm: str | None = None,
    length: int | None = None,
    class_options: Mapping[type, Callable] | None = None,
    debug: str | None = None,
    **kwargs,
) -> Result:
    """The value of ``fn(*args, **kwargs)``, from a store or newly made.

    ``store``: several are searched in order and the first is written to. ``use_cache``: False runs the function;
    a number is the deepest nesting that still uses the store; "overwrite" makes the entry anew; "devMode" replaces the
    one entry that carries all user tags. ``cache_id``: the key to use, or "previous" for the function's last entry.
    ``mirror``: a second store that misses are looked up in and new entries are copied to. ``debug``: "complete" adds
    the arguments as they were to the result, "quick" does so and neither looks anything up nor runs the function.

    What is not given (store, use_cache, show_similar, quick, mirror, in_memory, algorithm) is as the options say.
    """
    if debug not in (None, "complete", "quick"):
        raise ValueError("debug is complete or quick")
    session = store.spark if isinstance(store, Store) else store[0].spark if store else SparkSession.getActiveSession()
    settings = options(session)
    if store is None:
        if not settings.store_path:
            raise ValueError("give a store, or name one by the option store_path")
        store = Store(session, settings.store_path)
    use_cache = _use_cache(settings.use_cache) if use_cache is None else use_cache
    show_similar = settings.show_similar if show_similar is None else show_similar
    quick = settings.quick if quick is None else quick
    in_memory = settings.memory_layer if in_memory is None else in_memory
    if mirror is None and settings.use_mirror and settings.mirror_path:
        mirror = Store(session, settings.mirror_path)
    arguments = bound_arguments(fn, args, kwargs) if debug else None
    stores = store if isinstance(store, list) else [store]
    for s in stores:
        s.create()
    first = stores[0]
    outer = _NESTED.get()
    depth = len(outer)
    inherited = [t for level in outer for t in level]
    name = function_name or getattr(fn, "__qualname__", type(fn).__name__)
    own_tags = tag_ops.parse(user_tags)
    all_tags = [*inherited, *own_tags]
    if use_cache is False or (not isinstance(use_cache, (bool, str)) and depth >= int(use_cache)):
        return Result(fn(*args, **kwargs), "", True, arguments=arguments)

    began = time.perf_counter()
    key, hashes = call_key(fn, args, kwargs, omit=omit, only=only, extra=extra, quick=quick, algorithm=algorithm or settings.algorithm, length=length, class_options=class_options)
    digest_time = time.perf_counter() - began
    if cache_id == "previous":
        last = [r.cacheId for r in tag_ops.nth_latest(tag_ops.matching_ids(first.tags(), function=[name]), first.tags(), 1).collect()]
        key = last[0] if last else key
    elif cache_id:
        key = cache_id
    if digest_only or debug == "quick":
        return Result(None, key, False, hashes, arguments=arguments)

    with _lock(first, key), first.locked(key):
        entry = where = None
        for s in stores:
            if (entry := s.find(key)) is not None:
                where = s
                break
        if use_cache == "devMode" and entry is None and own_tags:
            wanted = first.spark.createDataFrame(own_tags, "tagKey string, tagValue string")
            tags = first.tags()
            same = [r.cacheId for r in tag_ops.carries_all(tags, wanted).join(tag_ops.matching_ids(tags, function=[name]), "cacheId", "left_semi").limit(2).collect()]
            if len(same) == 1:
                first.remove(same)
        if use_cache == "overwrite" and entry is not None:
            where.remove([key])
            entry = None
        if entry is None and mirror is not None and (there := mirror.find(key)) is not None:
            first.save(key, mirror.load(key, there), [(k, v) for k, vs in there.items() for v in vs if k not in ("objectId", "class", "createdDate")])
            entry, where = first.find(key), first
        fresh = entry is not None and (not_older_than is None or not_older_than <= dt.datetime.fromisoformat(entry["createdDate"][0]))
        if fresh:
            try:
                if key in where.memory:
                    value = where.memory[key]
                else:
                    load = time.perf_counter()
                    value = where.load(key, entry)
                    where.add_tag(key, "elapsedTimeLoad", f"{time.perf_counter() - load:.6f}")
                where.add_tag(key, "accessed", dt.datetime.now().isoformat(sep=" "))
                if in_memory:
                    where.memory[key] = value.persist() if isinstance(value, DataFrame) and key not in where.memory else value
                return Result(None if entry.get("isNone") else value, key, False, hashes, arguments=arguments)
            except Exception:
                where.remove([key])  # what can't be read is made anew

        near = similar_calls(first, hashes, name) if show_similar else []
        began = time.perf_counter()
        token = _NESTED.set((*outer, tuple(own_tags)))
        try:
            value = fn(*args, **kwargs)
        finally:
            _NESTED.reset(token)
        run_time = time.perf_counter() - began
        if entry is not None and not fresh:
            where.remove([key])  # only now: a failing run keeps the old entry
        if output_columns is not None:
            value = value.select(*output_columns) if isinstance(value, DataFrame) else {k: value[k] for k in output_columns}
        value = prepared(value)

        rows = [("function", name), ("accessed", dt.datetime.now().isoformat(sep=" ")), ("elapsedTimeDigest", f"{digest_time:.6f}"), ("elapsedTimeFirstRun", f"{run_time:.6f}")]
        rows += [*all_tags, *tags_for(value), *((f"preDigest:{k}", v) for k, v in hashes.items())]
        rows += [("otherFunctions", f.function) for f in inspect.stack()[1:6] if not f.function.startswith(("<", "_"))]
        if value is None:
            rows.append(("isNone", "true"))

        def save() -> None:
            if isinstance(value, DataFrame):
                first.save(key, value, rows)
                if link_result:
                    hashed = digest.frame_hash(first.load(key))
                    _link(first, key, hashed)
            elif isinstance(value, tuple(made for made, _, _ in CODECS.values())):
                first.save(key, value, rows)
                if link_result:
                    made, table, described = next(c for c in CODECS.values() if isinstance(value, c[0]))
                    kept = first.load(key)
                    _link(first, key, digest.text_hash(repr([made.__name__, digest.frame_hash(getattr(kept, table)), getattr(kept, described)])))
            else:
                hashed = digest.text_hash(repr(digest.plain(value)))
                twin = first.same_result(hashed) if link_result else None
                first.save(key, value, [*rows, ("resultHash", hashed)], *(twin or (None, None)))
            if mirror is not None:
                mirror.create()
                if mirror.find(key) is None:
                    mirror.save(key, first.load(key), rows)

        if not wait and not isinstance(value, DataFrame):
            _PENDING.append(_POOL.submit(save))
            return Result(value, key, True, hashes, near, arguments)
        save()
        kept = first.load(key)
        if in_memory:
            first.memory[key] = kept.persist() if isinstance(kept, DataFrame) else kept
        return Result(None if value is None else kept, key, True, hashes, near, arguments)


def _link(store: Store, key: str, hashed: str) -> None:
    """Point an entry at a stored object with an equal result, if there is one, and drop its own."""
    twin = store.same_result(hashed)
    entry = store.find(key)
    own = entry["objectId"][-1]
    if twin and twin[0] != own:
        store.add_tag(key, "objectId", twin[0])
        store._delete(store.object_path(own))
    store.add_tag(key, "resultHash", hashed)


def wait_for_writes(seconds: float = 10.0) -> None:
    """Wait for results that are still being written."""
    while _PENDING:
        _PENDING.pop().result(timeout=seconds)


def memoised(store: Store | list[Store], **settings):
    """Decorator: every call goes through ``memo``."""

    def wrap(fn: Callable) -> Callable:
        @functools.wraps(fn)
        def call(*args, **kwargs):
            return memo(fn, *args, store=store, **settings, **kwargs).value

        return call

    return wrap
