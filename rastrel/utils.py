"""Small helpers of drivers: paths, YAML, logging, seeds, timers and what a session's parallelism is."""

from __future__ import annotations

import json
import logging
import random
import re
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

ROOT = Path(__file__).resolve().parent.parent


def ensure_dir(path: str | Path) -> Path:
    made = Path(path)
    made.mkdir(parents=True, exist_ok=True)
    return made


def resolve_path(path: str | Path, root: Path = ROOT) -> Path:
    """path, against root where it is relative."""
    return Path(path) if Path(path).is_absolute() else root / path


def relative_path(path: str | Path, root: Path = ROOT) -> str:
    """path from root on; as it is where it lies elsewhere."""
    try:
        return str(Path(path).resolve().relative_to(root.resolve()))
    except ValueError:
        return str(path)


def default_output(input_path: str | Path, order: str, root: Path = ROOT) -> Path:
    """outputs/<order>/<name>.svg"""
    return root / "outputs" / order / f"{Path(input_path).stem}.svg"


def write_json(data: Any, path: str | Path, indent: int = 2) -> None:
    ensure_dir(Path(path).parent)
    Path(path).write_text(json.dumps(data, indent=indent, ensure_ascii=False), encoding="utf-8")


# YAML: block mappings and lists of scalars, which is all that settings need; the library is used where there is one.

_WORDS = {"null": None, "~": None, "": None, "true": True, "false": False}


def _scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return json.loads(text) if text[0] == '"' else text[1:-1].replace("''", "'")
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    if text.startswith(("[", "{")):
        try:
            return json.loads(text)
        except ValueError:
            inner = text[1:-1].strip()
            return [_scalar(x) for x in inner.split(",")] if inner else []
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _block(lines: list[tuple[int, str]], at: int, indent: int) -> tuple[Any, int]:
    listed = lines[at][1].startswith("- ")
    out: Any = [] if listed else {}
    while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("- ") == listed:
        text = lines[at][1]
        if listed:
            out.append(_scalar(text[2:]))
            at += 1
            continue
        found = re.match(r"""("(?:[^"\\]|\\.)*"|'[^']*'|[^:]+):(?:\s+(.*))?$""", text)
        if not found:
            raise ValueError(f"not a YAML mapping: {text}")
        key, value = str(_scalar(found[1])), found[2]
        at += 1
        if value is None and at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("- ")):
            out[key], at = _block(lines, at, lines[at][0])
        else:
            out[key] = _scalar(value or "")
    return out, at


def parse_yaml(text: str) -> Any:
    """The value of a YAML text of block mappings, lists and scalars; {} for an empty one."""
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        pass
    rows = [re.sub(r"\s+#.*$", "", x).rstrip() for x in text.splitlines() if x.strip() and not x.lstrip().startswith(("#", "---"))]
    lines = [(len(x) - len(x.lstrip()), x.lstrip()) for x in rows]
    if not lines:
        return {}
    found, at = _block(lines, 0, lines[0][0])
    if at < len(lines):
        raise ValueError(f"not understood: {lines[at][1]}")
    return found


def _lines(data: Any, indent: int) -> Iterator[str]:
    for key, value in data.items():
        if isinstance(value, dict) and value:
            yield f"{' ' * indent}{key}:"
            yield from _lines(value, indent + 2)
        elif isinstance(value, list) and value and not any(isinstance(v, (dict, list)) for v in value):
            yield f"{' ' * indent}{key}:"
            yield from (f"{' ' * indent}- {json.dumps(v, ensure_ascii=False)}" for v in value)
        else:
            yield f"{' ' * indent}{key}: {json.dumps(value, ensure_ascii=False)}"


def load_yaml(path: str | Path) -> dict[str, Any]:
    return parse_yaml(Path(path).read_text(encoding="utf-8"))


def dump_yaml(data: dict[str, Any], path: str | Path) -> None:
    ensure_dir(Path(path).parent)
    Path(path).write_text("".join(f"{x}\n" for x in _lines(data, 0)), encoding="utf-8")


def setup_logger(name: str, log_file: str | Path | None = None, level: int = logging.INFO) -> logging.Logger:
    """A logger to the console, and to a file if one is named; asked for again, it gets no handler twice."""
    logger = logging.getLogger(name)
    logger.setLevel(level)
    layout = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
    if not any(type(h) is logging.StreamHandler for h in logger.handlers):
        logger.addHandler(logging.StreamHandler())
    if log_file:
        path = str(Path(log_file).resolve())
        if not any(isinstance(h, logging.FileHandler) and h.baseFilename == path for h in logger.handlers):
            ensure_dir(Path(path).parent)
            logger.addHandler(logging.FileHandler(path, encoding="utf-8"))
    for h in logger.handlers:
        h.setFormatter(layout)
    return logger


def set_seed(seed: int) -> None:
    """Seeds the driver's generators; columns take theirs as rand(seed)."""
    import numpy as np

    random.seed(seed)
    np.random.seed(seed % (1 << 32))


class Stopwatch:
    def __init__(self) -> None:
        self.began = time.perf_counter()

    @property
    def elapsed(self) -> float:
        return time.perf_counter() - self.began


@contextmanager
def timer() -> Iterator[Stopwatch]:
    """A stopwatch for the block; its reading stays when the block has ended."""
    watch = Stopwatch()
    spent = None
    try:
        yield watch
    finally:
        spent = watch.elapsed
        watch.began = time.perf_counter() - spent


def utc_now() -> str:
    return datetime.now(UTC).isoformat()


# Parallelism: what a process group knows, a Spark session or task knows too.


def is_distributed(spark) -> bool:
    return not spark.conf.get("spark.master", "local").startswith("local") or world_size(spark) > 1


def world_size(spark) -> int:
    return spark.sparkContext.defaultParallelism


def rank() -> int:
    """The partition that a task works on; 0 on the driver."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0
