"""Channels on disk and download requests: configuration, read on the driver before any row is."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

#: Stages a pipeline can name; the list switches stages on and off, it does not order them.
# Stages, and those that need finished clips.
STAGES = ("autodownload", "transcribe", "analyze", "clips", "crop", "background", "subtitles", "title", "watermark", "music", "metadata", "notify")
NEED_CLIPS = frozenset({"crop", "background", "subtitles", "watermark", "music", "metadata", "notify"})


def discover(root: str | Path) -> list[str]:
    """Names of channel folders, sorted; hidden ones are skipped."""
    p = Path(root)
    return sorted(x.name for x in p.iterdir() if x.is_dir() and not x.name.startswith(".")) if p.is_dir() else []


def prepare(root: str | Path, name: str, folders: Sequence[str] = ("input", "output"), assets: Sequence[str] = ()) -> bool:
    """Make a channel's missing folders; True if every asset folder holds something."""
    base = Path(root) / name
    for f in (*folders, *assets):
        (base / f).mkdir(parents=True, exist_ok=True)
    return all(any((base / f).iterdir()) for f in assets)


def ensure_config(root: str | Path, name: str, default: str) -> str:
    """The channel's config.yaml as text, written from ``default`` if there is none; warns where it names another channel."""
    p = Path(root) / name / "config.yaml"
    if not p.exists():
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(default, encoding="utf-8")
        return default
    text = p.read_text(encoding="utf-8")
    named = re.search(r"(?m)^channel_name:[ \t]*(?:'([^'\n]*)'|\"([^\"\n]*)\"|([^#\n]*?))[ \t]*(?:#.*)?$", text)
    said = next((g for g in named.groups() if g is not None), "") if named else None
    if said != name:
        warnings.warn(f"{p} names the channel {said!r}, its folder {name!r}", stacklevel=2)
    return text


def valid_channels(root: str | Path, **kw) -> list[str]:
    return [c for c in discover(root) if prepare(root, c, **kw)]


def enabled_stages(pipeline: Sequence[str] | None, default: Sequence[str] = STAGES) -> set[str]:
    """Stages that run: those named, or the default; one that needs clips switches clip making on."""
    named = set(pipeline if pipeline else default) & set(STAGES)
    return named | ({"clips"} if named & NEED_CLIPS else set())


@dataclass(frozen=True)
class Request:
    title: str
    episodes: str
    voice: str | None = None
    max_quality: int | None = None
    player: str | None = None


def quality_number(value) -> int | None:
    try:
        return int(str(value).rstrip("pP")) if value not in (None, "") else None
    except ValueError:
        return None


def request_of(entry) -> Request:
    """A request from a mapping (with older key names) or a sequence (title, episodes[, voice[, quality[, player]]])."""
    if isinstance(entry, dict):
        pick = lambda *keys: next((entry[k] for k in keys if entry.get(k)), None)
        got = (pick("title", "name"), pick("episodes", "count"), pick("voice", "translation"), pick("quality", "max_quality"), pick("player"))
    elif isinstance(entry, Sequence) and not isinstance(entry, (str, bytes, bytearray)):
        if len(entry) < 2:
            raise ValueError("a request needs a title and episodes")
        got = (*entry, None, None, None)[:5]
    else:
        raise ValueError("a request is a mapping or a sequence")
    title, episodes, voice, quality, player = got
    if not title or episodes is None:
        raise ValueError("a request needs a title and episodes")
    text = lambda x: str(x) if x not in (None, "") else None
    return Request(str(title), str(episodes), text(voice), quality_number(quality), text(player))
