"""Configuration of a run: one JSON document over defaults, paths relative to its file."""

from __future__ import annotations

import json
import logging
import os
import shutil
from dataclasses import dataclass, field
from pathlib import Path

from .operators import clusters, display
from .operators.rules import Options, Rule, bundle, merge_payload

#: Names of what a run writes under its output folder; those of the taxonomy are kept by a reset.
OUTPUTS = ("links", "fetched", "classified", "clustered", "reports", "export.html", "log.jsonl")
KEPT = ("taxonomy.json", "assignments")
DEFAULTS: dict = {
    "input": "links.html", "output": "output", "taxonomy": "taxonomy.json", "assignments": "assignments", "ignored_folders": [],
    "fetch": {"force": False, "warmup": True, "homepage_on_failure": True, "proxy": {}, "domain_overrides": {}, "review_policy": {"trusted_access": {"enabled": False}}, "external_sources": {"enabled": False}},
    "classification": {}, "clustering": {"root_groups": [], "display": {}}, "logging": {"level": "INFO", "console": True},
}


@dataclass
class Config:
    """Options of all stages, and where their data lie."""

    raw: dict
    base: Path
    rules: list[Rule] = field(default_factory=list)
    options: Options = field(default_factory=Options)
    root_groups: list[dict] = field(default_factory=list)

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        """Without a file, the defaults; a taxonomy file that is there gives rules, and root groups if none are configured."""
        file = Path(path).resolve() if path else None
        raw = merge_payload(DEFAULTS, json.loads(file.read_text(encoding="utf-8")) if file and file.exists() else {})
        out = cls(raw, file.parent if file else Path.cwd())
        document = {}
        if out.path("taxonomy").exists():
            document = json.loads(out.path("taxonomy").read_text(encoding="utf-8"))
        scoring = merge_payload(document.get("scoring") or {}, raw["classification"])
        out.rules, out.options = bundle({**document, "scoring": scoring})
        groups = raw["clustering"].get("root_groups") or document.get("root_groups")
        out.root_groups = groups if isinstance(groups, list) else []
        return out

    def path(self, name: str) -> Path:
        given = Path(self.raw[name])
        return given if given.is_absolute() else self.base / given

    def out(self, name: str) -> str:
        return str(self.path("output") / name)

    def cluster_options(self, **over) -> clusters.Options:
        given = self.raw["clustering"]
        names = {"min_cluster_size": "min_cluster", "discovery_min_support": "discovery_min", "max_bookmarks_without_clustering": "inline", "discovery_root_name": "discovery", "tidy_root_name": "tidy"}
        return clusters.Options(**({names[k]: v for k, v in given.items() if k in names} | over))

    def display_options(self) -> display.Options:
        given = self.raw["clustering"].get("display") or {}
        names = {
            "max_depth": "max_depth", "collapse_single_child": "collapse", "grouping_mode": "mode", "main_group_name": "main", "fallback_group_name": "fallback", "discovery_root_name": "discovery", "tidy_root_name": "tidy",
            "max_direct_normal_roots": "max_direct_roots", "standalone_discovery_min_count": "standalone_discovery", "tidy_semantic_min_support": "semantic_min", "tidy_root_fallback_min_count": "root_min",
            "tidy_resource_group_min_count": "resource_min", "tidy_resource_group_max_count": "resource_max", "oversized_leaf_threshold": "oversized",
        }
        small = max(2, self.raw["clustering"].get("min_cluster_size", 10) // 2)
        return display.Options(**({"small": small} | {names[k]: v for k, v in given.items() if k in names}))

    def logger(self) -> logging.Logger:
        """Lines of JSON to the output folder's log, and to the console if asked for."""
        log = logging.getLogger("linkloom")
        log.handlers.clear()
        log.setLevel(str(self.raw["logging"].get("level", "INFO")).upper())
        log.propagate = False
        os.makedirs(self.path("output"), exist_ok=True)
        handlers: list[logging.Handler] = [logging.FileHandler(self.out("log.jsonl"), encoding="utf-8")]
        if self.raw["logging"].get("console", True):
            handlers.append(logging.StreamHandler())
        for handler in handlers:
            handler.setFormatter(_JsonLines())
            log.addHandler(handler)
        return log


class _JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "message": record.getMessage()}, ensure_ascii=False)


def reset(config: Config, clear_cache: bool = False) -> list[str]:
    """Delete what a run wrote, but never its input, its taxonomy, nor, unless asked to, what was fetched; the names of what went."""
    source = config.path("input").resolve()
    gone = []
    for name in OUTPUTS:
        target = Path(config.out(name))
        if name == "fetched" and not clear_cache or not target.exists() or source == target.resolve() or target.resolve() in source.parents:
            continue
        shutil.rmtree(target) if target.is_dir() else target.unlink()
        gone.append(name)
    return gone


def require_input(config: Config) -> Path:
    """The input file, which is read where it lies; an error if it is not there."""
    source = config.path("input")
    if not source.exists():
        raise FileNotFoundError(f"no input at {source}")
    return source


def taxonomy_document(new: list[Rule], groups: list[dict]) -> dict:
    return {
        "schema_version": "user_taxonomy/v1", "root_groups": groups,
        "categories": {r.category: {"domains": list(r.domains), "keywords": list(r.keywords), "title_patterns": list(r.title_patterns)} for r in new},
    }
