"""Publishing several outputs at once, and guarding inputs against being overwritten."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import shutil
import tempfile
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path


def same_file(a: str, b: str) -> bool:
    """Equal paths, or two names of one file."""
    if os.path.realpath(a) == os.path.realpath(b):
        return True
    return os.path.exists(a) and os.path.exists(b) and os.path.samefile(a, b)


def guard(inputs: Iterable[str], outputs: Iterable[str]) -> None:
    """Refuses outputs that are inputs, and outputs that are each other."""
    outputs = list(outputs)
    for i, out in enumerate(outputs):
        for other in [*inputs, *outputs[:i]]:
            if same_file(out, other):
                raise ValueError(f"output {out} is also {other}")


def publish(targets: Mapping[str, Callable[[str], None]], overwrite: bool = True) -> None:
    """Writes all targets into a staging folder, then moves them into place; all or none.

    Each writer gets the path to write to.  A lock beside the targets keeps two publications apart; old files
    are set aside and come back if a move fails.
    """
    guard([], targets)
    folders = {os.path.dirname(os.path.abspath(t)) for t in targets}
    if len(folders) != 1:
        raise ValueError("targets lie in one folder")
    folder = folders.pop()
    stage = tempfile.mkdtemp(prefix=".stage-", dir=folder)
    try:
        for target, write in targets.items():
            write(os.path.join(stage, os.path.basename(target)))
        with open(os.path.join(folder, ".publish.lock"), "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            if not overwrite and (there := [t for t in targets if os.path.exists(t)]):
                raise FileExistsError(there[0])
            moved: list[tuple[str, str | None]] = []
            try:
                for target in targets:
                    old = os.path.join(stage, "old-" + os.path.basename(target)) if os.path.exists(target) else None
                    if old:
                        os.replace(target, old)
                    moved.append((target, old))
                    os.replace(os.path.join(stage, os.path.basename(target)), target)
            except OSError:
                for target, old in reversed(moved):
                    if old:
                        os.replace(old, target)
                    elif os.path.exists(target):
                        os.remove(target)
                raise
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def intact(path: str, size: int, sha256: str) -> bool:
    """Whether a cached resource has the size and digest of its manifest."""
    p = Path(path)
    if not p.is_file() or p.stat().st_size != size:
        return False
    with p.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest() == sha256


def clear_cache(cache: str, confirm: bool = False) -> bool:
    """Removes a cache folder, if that is confirmed; whether it was there."""
    if not confirm:
        raise ValueError("clearing the cache must be confirmed")
    there = os.path.isdir(cache)
    shutil.rmtree(cache, ignore_errors=True)
    return there


def resource(key: str, manifest: Mapping[str, Mapping], cache: str) -> str | None:
    """Path of a cached resource, or None where it is missing or damaged; names cannot leave the cache."""
    if key not in manifest:
        raise KeyError(key)
    entry = manifest[key]
    path = os.path.realpath(os.path.join(cache, entry["path"]))
    if not path.startswith(os.path.realpath(cache) + os.sep):
        raise ValueError("a resource lies outside the cache")
    return path if intact(path, int(entry["bytes"]), entry["sha256"]) else None


def cached_pair(folder: str, key: str, make: Callable[[], tuple[object, object]]) -> tuple[object, object]:
    """A layout and its positions as JSON, kept as a pair: taken from the folder only if both are there and belong together.

    The pair is written at once under a lock, so a reader never sees one half of it; a damaged or half pair is made anew.
    """
    name = hashlib.sha256(key.encode()).hexdigest()[:16]
    paths = [os.path.join(folder, f"{name}.{part}.json") for part in ("layout", "positions")]
    try:
        both = [json.loads(Path(p).read_text(encoding="utf-8")) for p in paths]
        if both[0]["key"] == both[1]["key"] == key and both[0]["pair"] == both[1]["pair"]:
            return both[0]["value"], both[1]["value"]
    except (OSError, ValueError, KeyError, TypeError):
        pass
    made = make()
    pair = hashlib.sha256(json.dumps([key, *made], sort_keys=True).encode()).hexdigest()
    os.makedirs(folder, exist_ok=True)
    texts = [json.dumps({"key": key, "pair": pair, "value": v}) for v in made]
    publish({p: (lambda to, t=t: Path(to).write_text(t, encoding="utf-8")) for p, t in zip(paths, texts)})
    return made
