"""Checks of single options; each gives the value back or names the option that is wrong."""

from __future__ import annotations

import math
import os
import re
from typing import Any


def text(value: Any, name: str, empty: bool = False) -> str:
    """One string, not empty unless that is allowed."""
    if not isinstance(value, str) or not (value or empty):
        raise ValueError(f"{name} must be a {'' if empty else 'filled '}text")
    return value


def flag(value: Any, name: str) -> bool:
    """True or false, nothing that only looks like it."""
    if not isinstance(value, bool):
        raise ValueError(f"{name} must be true or false")
    return value


def whole(value: Any, name: str, least: int | None = None, most: int | None = None) -> int:
    """An integer within bounds; a float without fraction is one, a flag is not."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value != int(value):
        raise ValueError(f"{name} must be a whole number")
    if (least is not None and value < least) or (most is not None and value > most):
        raise ValueError(f"{name} must lie between {least} and {most}" if most is not None else f"{name} must be at least {least}")
    return int(value)


def number(value: Any, name: str, least: float | None = None, most: float | None = None) -> float:
    """A finite number within bounds."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError(f"{name} must be a number")
    if (least is not None and value < least) or (most is not None and value > most):
        raise ValueError(f"{name} must lie between {least} and {most}")
    return float(value)


def choice(value: Any, name: str, known: tuple[str, ...]) -> str:
    if value not in known:
        raise ValueError(f"{name} must be one of {', '.join(known)}")
    return value


def existing_file(value: Any, name: str) -> str:
    """A path of a file that is there; addresses with a file system of their own are left to it."""
    path = text(value, name)
    if "://" not in path and not os.path.isfile(path):
        raise FileNotFoundError(f"{name}: {path}")
    return path


def prefix(value: Any, name: str) -> str:
    """Beginning of output paths: its folder is there, and its last part is a name."""
    path = text(value, name)
    folder, last = os.path.split(os.path.abspath(path))
    if path.endswith(os.sep) or not last or not os.path.isdir(folder):
        raise ValueError(f"{name} must be a file prefix in an existing folder")
    return path


def name_of_sample(value: Any, name: str = "sample") -> str:
    """A name without blanks and colons, as tags need it."""
    if re.search(r"[\s:]", text(value, name)):
        raise ValueError(f"{name} has no blank and no colon")
    return value
