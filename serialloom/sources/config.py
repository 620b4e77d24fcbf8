"""Site profiles and configuration from INI files."""

from __future__ import annotations

import configparser
import warnings
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PROFILES = "name string, host string, chapter_marker string, content_selector string, paragraph_selector string, toc_page_param string, max_toc_pages int"


@dataclass(frozen=True)
class Config:
    output_dir: str = "library"
    log_path: str = "sync.log"
    request_delay_ms: int = 1500
    poll_interval_mins: int = 60
    retention_days: int = 30
    quiet_grace_days: int = 30
    recheck_days: int = 7
    volume_size: int = 0
    auto_export: bool = True
    auto_append: bool = True


def read_config(text: str) -> Config:
    """Tolerant: a key that is missing or makes no sense has its default."""
    parser = configparser.ConfigParser(strict=False, interpolation=None)
    try:
        parser.read_string(text if text.lstrip().startswith("[") else "[main]\n" + text)
    except configparser.Error:
        return Config()
    found = {k: v for s in parser.sections() for k, v in parser.items(s)}
    out = {}
    for f in fields(Config):
        if (raw := found.get(f.name)) is None:
            continue
        if f.type == "bool":
            out[f.name] = raw.strip().lower() in ("true", "yes", "1", "on")
        elif f.type == "int":
            if raw.strip().isdigit():
                out[f.name] = int(raw)
        else:
            out[f.name] = raw.strip()
    return Config(**out)


def write_config(config: Config) -> str:
    return "[main]\n" + "".join(f"{f.name} = {str(getattr(config, f.name)).lower() if f.type == 'bool' else getattr(config, f.name)}\n" for f in fields(Config))


def read_profile(text: str) -> tuple:
    """A profile's row. name, host and chapter_marker are required, the rest has defaults."""
    parser = configparser.ConfigParser(strict=False, interpolation=None)
    parser.read_string(text if text.lstrip().startswith("[") else "[site]\n" + text)
    found = {k: v.strip() for s in parser.sections() for k, v in parser.items(s)}
    for key in ("name", "host", "chapter_marker"):
        if not found.get(key):
            raise ValueError(f"the profile has no {key}")
    return (found["name"], found["host"].lower(), found["chapter_marker"], found.get("content_selector", "#chapter-content"), found.get("paragraph_selector", "p"), found.get("toc_page_param", "page"), int(found.get("max_toc_pages", 500)))


def profiles(spark: SparkSession, folder: str | None = None, built_in: list[tuple] = ()) -> DataFrame:
    """Built-in profiles, then those of ``folder``; a file that cannot be read is skipped with a warning."""
    rows = list(built_in)
    for path in sorted(Path(folder).glob("*.ini")) if folder else []:
        try:
            rows.append(read_profile(path.read_text()))
        except (ValueError, configparser.Error) as e:
            warnings.warn(f"{path.name}: {e}", stacklevel=2)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rank int, " + PROFILES)
