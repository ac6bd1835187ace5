"""Output folders and files on the driver: names, fresh folders, whole downloads, tools and model files."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Callable
from datetime import datetime
from pathlib import Path


def sanitized(name: str) -> str:
    """A name without what file systems refuse; 'output' if nothing is left."""
    return re.sub(r'[<>:"/\\|?*\s]+', "_", name).strip("._") or "output"


def output_dir(input_path: str, root: str, token: str | None = None, now: datetime | None = None) -> Path:
    """A fresh folder for an input's outputs: its stem (and token), or with a time stamp, then _2, _3, ..., where that folder has content."""
    stem = sanitized(Path(input_path).stem) + (f"_{sanitized(token)}" if token else "")
    at = Path(root) / stem
    if not at.exists() or at.is_dir() and not any(at.iterdir()):
        at.mkdir(parents=True, exist_ok=True)
        return at
    stamped = Path(root) / f"{stem}_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}"
    fresh, k = stamped, 2
    while fresh.exists():
        fresh, k = stamped.with_name(f"{stamped.name}_{k}"), k + 1
    fresh.mkdir(parents=True)
    return fresh


def written_whole(data: bytes, target: str, valid: Callable[[Path], None] | None = None) -> Path:
    """Write a file so that it is there whole and checked, or not at all."""
    at, part = Path(target), Path(f"{target}.partial")
    at.parent.mkdir(parents=True, exist_ok=True)
    try:
        part.write_bytes(data)
        if valid:
            valid(part)
        os.replace(part, at)
    finally:
        part.unlink(missing_ok=True)
    return at


def check_model_file(path: str, name: str, least_bytes: int) -> None:
    """An error if a model's file is missing or too small to be whole."""
    at = Path(path)
    if not at.is_file():
        raise FileNotFoundError(f"{name}: {path} is missing")
    if at.stat().st_size < least_bytes:
        raise ValueError(f"{name}: {path} has {at.stat().st_size} bytes, at least {least_bytes} are expected")


def media_tools(which: Callable[[str], str | None] = shutil.which, exists: Callable[[str], bool] = os.path.exists, folders: tuple[str, ...] = ()) -> dict[str, str | None]:
    """Where ffmpeg and ffprobe are: on the path, else in one of the folders; source tells which."""
    found: dict[str, str | None] = {t: which(t) for t in ("ffmpeg", "ffprobe")}
    source = "path" if found["ffmpeg"] else None
    for folder in folders:
        if not found["ffmpeg"]:
            at = f"{folder.rstrip('/')}/ffmpeg"
            if exists(at):
                probe = f"{folder.rstrip('/')}/ffprobe"
                found, source = {"ffmpeg": at, "ffprobe": probe if exists(probe) else found["ffprobe"]}, folder
    return found | {"source": source}
