"""Read layouts: ordered elements of a read, from CSV files, seqspec YAML or a table."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Element:
    """One part of a read; ``lengths`` are the lengths it may have, empty where any."""

    id: str
    kind: str  # static or variable
    cls: str = ""
    seq: str = ""
    lengths: tuple[int, ...] = ()
    whitelist: str = ""
    flags: str = ""

    @property
    def length(self) -> int | None:
        """Length used where one is needed: the last candidate."""
        return len(self.seq) if self.seq else self.lengths[-1] if self.lengths else None


def lengths(text: str | None) -> tuple[int, ...]:
    """``16`` or ``15-16``."""
    if not text or not text.strip():
        return ()
    m = re.fullmatch(r"(\d+)(?:-(\d+))?", text.strip())
    if not m or m[2] and int(m[2]) < int(m[1]):
        raise ValueError(f"not a length: {text!r}")
    return tuple(range(int(m[1]), int(m[2] or m[1]) + 1))


def _element(row: dict) -> Element:
    get = lambda k: (row.get(k) or "").strip()
    if not get("id"):
        raise ValueError("an element needs an id")
    kind = get("type") or ("static" if get("seq") else "variable")
    if kind not in ("static", "variable"):
        raise ValueError(f"unknown type {kind!r} of element {get('id')!r}")
    seq = get("seq").upper()
    return Element(get("id"), kind, get("class"), seq if re.fullmatch("[ACGTN]+", seq) else "", lengths(get("expected_length")), get("whitelist"), get("flags"))


def from_rows(rows: Iterable[dict]) -> list[Element]:
    """Elements of the rows of a layout table, in order of ``element_no``."""
    return [_element(r) for r in sorted(rows, key=lambda r: r["element_no"])]


def from_csv(text: str) -> list[Element]:
    """Elements of a layout file: an optional title line, a header, one row an element; a byte-order mark is allowed."""
    lines = text.removeprefix("﻿").splitlines()
    while lines and "id" not in [c.strip() for c in next(csv.reader([lines[0]]), [])]:
        lines.pop(0)
    if not lines:
        raise ValueError("no header with a column id")
    rows = [{(k or "").strip(): v for k, v in r.items() if isinstance(v, str)} for r in csv.DictReader(io.StringIO("\n".join(lines)))]
    out = [_element(r) for r in rows if (r.get("id") or "").strip()]
    if not out:
        raise ValueError("no elements")
    return out


#: Region types of seqspec files and the classes they become.
REGION_CLASS = {"barcode": "barcode", "umi": "umi", "cdna": "read", "gdna": "read", "linker": "linker", "poly_t": "poly_t", "poly_a": "poly_a", "tso": "tso"}


def from_seqspec(text: str, whitelist: str | None = None) -> list[Element]:
    """Leaves of the region tree: fixed sequences are static, random ones reads, those with a list barcodes.

    A remote list is refused unless ``whitelist`` is given in its place.
    """
    import yaml

    spec = yaml.safe_load(text)
    out: list[Element] = []

    def walk(region: dict) -> None:
        if children := region.get("regions"):
            for r in children:
                walk(r)
            return
        kind, onlist = region.get("sequence_type"), region.get("onlist") or {}
        seq = str(region.get("sequence") or "").upper()
        span = tuple(range(int(region.get("min_len") or 0), int(region.get("max_len") or 0) + 1)) if region.get("max_len") else ()
        cls = REGION_CLASS.get(str(region.get("region_type")), "")
        rid = str(region["region_id"])
        if kind == "fixed":
            out.append(Element(rid, "static", cls, seq, ()))
        elif kind == "onlist":
            place = str(onlist.get("filename") or "") if isinstance(onlist, dict) else str(onlist)
            remote = isinstance(onlist, dict) and (onlist.get("location") == "remote" or "://" in str(onlist.get("url") or "") or "://" in place)
            if remote and not whitelist:
                raise ValueError(f"the list of {rid!r} is remote; name a whitelist")
            out.append(Element(rid, "variable", "barcode", "", span, whitelist if remote else place))
        else:
            out.append(Element(rid, "variable", cls or "read", "", span if cls in ("umi", "barcode") else ()))

    for r in spec["library_spec"]:
        walk(r)
    return out


def read_pattern(layout: list[Element]) -> tuple[str, list[str]]:
    """Regular expression of a whole forward read, and the ids of its captures.

    Sequences with known bases stand for themselves, poly-T and poly-A are runs
    of any length, variable parts of known length are captured.  The read itself
    is captured up to the next anchor; behind the last capture that is the first
    of the layout's anchors that occurs, or the end of a molecule cut short.
    """
    parts, names = [], []
    for i, e in enumerate(layout):
        if e.seq:
            parts.append(e.seq.replace("N", "[ACGTN]"))
        elif e.cls in ("poly_t", "poly_a"):
            parts.append("T*" if e.cls == "poly_t" else "A*")
        elif e.cls == "read":
            names.append(e.id)
            rest = layout[i + 1 :]
            if any(x.kind == "variable" for x in rest):
                parts.append("(.*?)")
                continue
            anchors = "|".join(x.seq.replace("N", "[ACGTN]") for x in rest if x.seq)
            poly = "".join("T*" if x.cls == "poly_t" else "A*" for x in rest if x.cls in ("poly_t", "poly_a"))
            parts.append(f"(.*?)(?:{poly}(?:{anchors}).*)?$" if anchors else "(.*)$")
            break
        else:
            if e.length is None:
                raise ValueError(f"element {e.id!r} has no length")
            span = f"{e.lengths[0]},{e.lengths[-1]}" if len(e.lengths) > 1 else e.length
            parts.append(f"([ACGTN]{{{span}}})")
            names.append(e.id)
    return "".join(parts), names
