"""What surrounds the data: configuration, paths, log retention, result rows, timings."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT_LOGS = 50
#: Folders by name, where the configuration names none.
FOLDERS = {"data_dir": "data", "index_dir": "index", "doc_logs_dir": "logs", "visitor_state_dir": "states"}
log = logging.getLogger("lodestream")


def load_config(path: str | Path) -> dict[str, Any]:
    """A YAML or JSON mapping; empty if the file is missing, broken or holds no mapping."""
    try:
        text = Path(path).read_text("utf-8")
        try:
            import yaml
        except ImportError:
            data = json.loads(text)
        else:
            data = yaml.safe_load(text)
    except Exception as e:
        log.error("configuration %s: %s", path, e)
        return {}
    return data if isinstance(data, dict) else {}


def resolve_paths(config: dict[str, Any]) -> dict[str, Path]:
    named = config.get("paths") or {}
    return {k: Path(named.get(k, default)).expanduser().resolve() for k, default in FOLDERS.items()}


def retained(files: DataFrame, keep: int = KEPT_LOGS, running: str = "current.log") -> DataFrame:
    """Log files (name, mtime) with ``keep``: the newest archives, and the running one, which does not count.

    Archives are few; of equal times the lesser name counts as newer.
    """
    archive = F.col("name").endswith(".log") & (F.col("name") != running)
    newest = files.where(archive).orderBy(F.desc("mtime"), "name").limit(keep).select(F.col("name").alias("kept"))
    marked = files.join(F.broadcast(newest), F.col("name") == F.col("kept"), "left")
    return marked.withColumn("keep", ~archive | F.col("kept").isNotNull()).drop("kept")


def result_json(df: DataFrame) -> DataFrame:
    """One JSON document a row, as it is sent to a caller."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


class Timings:
    """Seconds of named parts of a call, and their sum."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def part(self, name: str) -> Iterator[None]:
        at = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - at

    def report(self) -> dict[str, float]:
        return {**self.seconds, "total": sum(self.seconds.values())}
