"""Configuration from files: a reader for plain YAML, typed settings with paths from the environment, year calendars."""

from __future__ import annotations

import datetime
import os
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

HERE = Path(__file__).resolve().parent.parent / "config"


def scalar(text: str) -> Any:
    """What a bare or quoted word of YAML means."""
    t = text.strip()
    if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'":
        return t[1:-1]
    if t in ("", "~", "null"):
        return None
    if t in ("true", "false"):
        return t == "true"
    for kind in (int, float, datetime.date.fromisoformat):
        try:
            return kind(t)
        except ValueError:
            pass
    return t


def flow(text: str, at: int = 0) -> tuple[Any, int]:
    """A flow value, ``[..]``, ``{..}`` or a word, and where it ends."""
    while at < len(text) and text[at] == " ":
        at += 1
    if at < len(text) and text[at] in "[{":
        close = {"[": "]", "{": "}"}[text[at]]
        items, mapping, at = [], text[at] == "{", at + 1
        while True:
            while text[at] in " ,":
                at += 1
            if text[at] == close:
                return (dict(items) if mapping else items), at + 1
            if mapping:
                end = text.index(":", at)
                value, stop = flow(text, end + 1)
                items.append((scalar(text[at:end]), value))
            else:
                value, stop = flow(text, at)
                items.append(value)
            at = stop
    if at < len(text) and text[at] in "\"'":
        end = text.index(text[at], at + 1)
        return text[at + 1 : end], end + 1
    end = next((i for i in range(at, len(text)) if text[i] in ",]}"), len(text))
    return scalar(text[at:end]), end


def read_yaml(text: str) -> dict[str, Any]:
    """Nested maps and lists by indentation, flow values on one line, comments; no text is an empty map."""
    lines = []
    for raw in text.splitlines():
        body = re.sub(r"""(^|\s)#(?=(?:[^"']*["'][^"']*["'])*[^"']*$).*""", "", raw).rstrip()
        if body.strip():
            lines.append((len(body) - len(body.lstrip()), body.strip()))

    def value(rest: str, at: int, indent: int) -> tuple[Any, int]:
        if rest:
            return flow(rest)[0], at
        if at < len(lines) and lines[at][0] > indent:
            return block(at, lines[at][0])
        if at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("- "):
            return block(at, indent)
        return None, at

    def block(at: int, indent: int) -> tuple[Any, int]:
        items: list[Any] = []
        out: dict[str, Any] = {}
        while at < len(lines) and lines[at][0] == indent:
            body = lines[at][1]
            if body.startswith("- "):
                items.append(flow(body[2:])[0])
                at += 1
            elif items:
                break
            else:
                key, _, rest = body.partition(":")
                out[scalar(key)], at = value(rest.strip(), at + 1, indent)
        return (items or out), at

    return block(0, lines[0][0])[0] if lines else {}


def load_yaml(path: str | Path) -> dict[str, Any]:
    return read_yaml(Path(path).read_text(encoding="utf-8"))


@dataclass(frozen=True)
class Window:
    """A trade window in minutes of the day."""

    start: int = 600
    end: int = 630
    buffer_min: int = 5


@dataclass(frozen=True)
class Settings:
    """Typed settings; unknown keys are an error. ``LEDGERBARS_DATA`` and ``LEDGERBARS_LOGS`` override the paths."""

    env: str = "dev"
    timezone: str = "Asia/Kolkata"
    data: str = "data"
    logs: str = "logs"
    silence_s: int = 10
    instruments_per_connection: int = 3000
    watchlist: int = 50
    max_skew_s: float = 2.0
    keep_days: int = 90
    trade_window: Window = field(default_factory=Window)


#: Groups of a settings file, and which field each of their keys is.
GROUPS = ("paths", "ticker", "clock", "data", "log")
NAMES = {"data_dir": "data", "logs_dir": "logs", "heartbeat_silence_kill_s": "silence_s", "max_instruments_per_conn": "instruments_per_connection", "universe_max_watchlist": "watchlist", "max_skew_s": "max_skew_s", "keep_days": "keep_days"}


def minutes(hhmm: str) -> int:
    h, m = hhmm.split(":")[:2]
    return int(h) * 60 + int(m)


def settings(path: str | Path = HERE / "settings.yaml", environ: dict[str, str] | None = None) -> Settings:
    raw, env = load_yaml(path), os.environ if environ is None else environ
    known = {"env", "timezone", *GROUPS, "trade_window"}
    if extra := set(raw) - known:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    w = raw.get("trade_window") or {}
    flat = {"env": raw.get("env"), "timezone": raw.get("timezone")}
    for group in GROUPS:
        if extra := set(raw.get(group) or {}) - set(NAMES):
            raise ValueError(f"unknown settings in {group}: {sorted(extra)}")
        flat |= {NAMES[k]: v for k, v in (raw.get(group) or {}).items()}
    flat |= {k: v for k, v in (("data", env.get("LEDGERBARS_DATA")), ("logs", env.get("LEDGERBARS_LOGS"))) if v}
    window = Window(minutes(w["start_ist"]), minutes(w["end_ist"]), int(w.get("squareoff_buffer_min") or 0)) if w else Window()
    return Settings(**{k: v for k, v in flat.items() if v is not None}, trade_window=window)


def limits(path: str | Path = HERE / "limits.yaml") -> dict[str, Any]:
    """The limits by rule, with the base, the least confidence and our own choices beside them."""
    raw = load_yaml(path)
    return raw["limits"] | {k: v for k, v in raw.items() if k != "limits"}


@dataclass(frozen=True)
class Year:
    """One year's calendar: holidays, sessions of their own times (start, end), and how far it is verified."""

    year: int
    holidays: frozenset[datetime.date]
    special: dict[datetime.date, tuple[int, int]]
    shortened: dict[datetime.date, tuple[int, int]]
    pre_open: tuple[int, int]
    continuous: tuple[int, int]
    post_close: tuple[int, int] | None
    verified: bool
    verified_through: datetime.date | None


def year_of(raw: dict[str, Any]) -> Year:
    s = raw.get("sessions") or {}
    span = lambda x, default: (minutes(x["start"]), minutes(x["end"])) if x else default
    own = lambda name: {x["date"]: span(x, None) for x in raw.get(name) or []}
    days = frozenset(x["date"] if isinstance(x, dict) else x for x in raw.get("holidays") or [])
    return Year(int(raw["year"]), days, own("special_sessions"), own("shortened_sessions"), span(s.get("pre_open"), (540, 555)), span(s.get("continuous"), (555, 930)), span(s.get("post_close"), None), bool(raw.get("verified")), raw.get("verified_through"))


def calendar(folder: str | Path = HERE / "calendar") -> dict[int, Year]:
    """The years of a folder's files by name; the last file of a year counts, files without a year do not. No folder, no years."""
    out: dict[int, Year] = {}
    for p in sorted(Path(folder).glob("*.yaml")) if Path(folder).exists() else []:
        raw = load_yaml(p)
        if "year" in raw:
            y = year_of(raw)
            out[y.year] = y
    return out


def horizon_of(years: dict[int, Year]) -> datetime.date | None:
    """The last verified day of any year."""
    return max((y.verified_through for y in years.values() if y.verified and y.verified_through), default=None)
