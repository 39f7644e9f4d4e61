"""Configuration: defaults, then a file, then CRAWLER_* variables, then flags."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

LANGUAGES = tuple("ar de en es fr hi it ja ko pt ru zh".split())
STORES = tuple("badger file postgres s3".split())


@dataclass
class Crawler:
    max_pages: int = 10_000
    max_depth: int = 5
    concurrent_workers: int = 10
    include_patterns: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    allowed_domains: list[str] = field(default_factory=list)
    blocked_domains: list[str] = field(default_factory=list)
    global_rate_limit: float = 5.0
    global_rate_burst: int = 10
    per_host_rate_limit: float = 3.0
    per_host_rate_burst: int = 5
    user_agent: str = "corpusloom/1.0"
    seed_urls: list[str] = field(default_factory=list)
    request_timeout_s: float = 30.0


@dataclass
class Deduplication:
    enabled: bool = True
    content_fingerprinting: bool = True
    #: Turns near-duplicate fingerprints on.
    semantic_similarity: bool = True
    similarity_threshold: float = 0.85


@dataclass
class Content:
    min_text_length: int = 100
    max_text_length: int = 100_000
    languages: list[str] = field(default_factory=lambda: ["en"])
    #: 0 keeps the extractor's own threshold.
    quality_threshold: float = 0.7
    remove_boilerplate: bool = True
    extract_main_content: bool = True
    normalize_whitespace: bool = True
    deduplication: Deduplication = field(default_factory=Deduplication)


@dataclass
class Frontier:
    queue_capacity: int = 100_000


@dataclass
class Robots:
    enabled: bool = True
    cache_duration_s: int = 86_400
    user_agent: str = "*"


@dataclass
class Http:
    max_retries: int = 3
    base_delay_ms: int = 500
    max_delay_ms: int = 30_000
    multiplier: float = 2.0


@dataclass
class Store:
    type: str = "file"
    path: str = "./data"
    connection_string: str = ""


@dataclass
class Redis:
    addr: str = ""
    password: str = ""
    db: int = 0


@dataclass
class Features:
    javascript_rendering: bool = False


@dataclass
class Config:
    crawler: Crawler = field(default_factory=Crawler)
    content: Content = field(default_factory=Content)
    frontier: Frontier = field(default_factory=Frontier)
    robots: Robots = field(default_factory=Robots)
    http: Http = field(default_factory=Http)
    storage: Store = field(default_factory=Store)
    redis: Redis = field(default_factory=Redis)
    features: Features = field(default_factory=Features)

    def __str__(self) -> str:
        return json.dumps(redact(_plain(self)), sort_keys=True)


def _plain(x: Any) -> Any:
    return {f.name: _plain(getattr(x, f.name)) for f in fields(x)} if is_dataclass(x) else x


def redact(x: Any) -> Any:
    """Secrets as stars, in values of telling names and in connection strings."""
    if isinstance(x, dict):
        return {k: ("***" if v and re.search("password|secret|token", k) else redact(v)) for k, v in x.items()}
    return redact_connection(x) if isinstance(x, str) else x


def redact_connection(text: str) -> str:
    text = re.sub(r"(://[^:/@\s]*):[^@/\s]*@", r"\1:***@", text)
    return re.sub(r"(?i)(password|pwd)=[^\s;]*", r"\1=***", text)


def _set(obj: Any, key: str, value: Any) -> None:
    old = getattr(obj, key)
    if is_dataclass(old):
        if not isinstance(value, dict):
            raise ValueError(f"{key} must be a section")
        for k, v in value.items():
            if hasattr(old, k):
                _set(old, k, v)
        return
    if isinstance(old, bool):
        value = value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    elif isinstance(old, int):
        value = int(value)
    elif isinstance(old, float):
        value = float(value)
    elif isinstance(old, list):
        value = [str(v).strip() for v in (value.split(",") if isinstance(value, str) else value) if str(v).strip()]
    setattr(obj, key, value)


def parse_yaml(text: str) -> dict:
    """The plain subset of YAML that configuration files use: nested maps, lists and scalars."""
    root: dict = {}
    stack: list[tuple[int, Any, Any]] = [(-1, root, None)]

    def scalar(s: str) -> Any:
        s = s.strip()
        if s[:1] in "\"'" and s[-1:] == s[:1] and len(s) > 1:
            return s[1:-1]
        if s.startswith("[") and s.endswith("]"):
            return [scalar(x) for x in s[1:-1].split(",") if x.strip()]
        low = s.lower()
        if low in ("true", "false"):
            return low == "true"
        if low in ("", "null", "~"):
            return None
        for kind in (int, float):
            try:
                return kind(s)
            except ValueError:
                pass
        return s

    for line in text.splitlines():
        bare = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not bare.strip():
            continue
        indent, bare = len(bare) - len(bare.lstrip()), bare.strip()
        while stack[-1][0] >= indent and not (bare.startswith("- ") and stack[-1][0] == indent and isinstance(stack[-1][1], list)):
            stack.pop()
        where = stack[-1][1]
        if bare.startswith("- "):
            if isinstance(where, dict) and stack[-1][2] is not None:
                holder, key = stack[-1][2]
                holder[key] = where = []
                stack[-1] = (stack[-1][0], where, (holder, key))
            where.append(scalar(bare[2:]))
            continue
        key, _, value = bare.partition(":")
        key = key.strip().strip("\"'")
        if value.strip():
            where[key] = scalar(value)
        else:
            where[key] = {}
            stack.append((indent, where[key], (where, key)))
    return root


def load(path: str | None = None, flags: dict[str, Any] | None = None, env: dict[str, str] | None = None) -> Config:
    """``flags`` are dotted names, as ``crawler.max_pages``; variables spell them CRAWLER_CRAWLER_MAX_PAGES."""
    cfg = Config()
    if path:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        data = json.loads(text) if path.endswith(".json") else parse_yaml(text)
        for k, v in data.items():
            if hasattr(cfg, k) and v is not None:
                _set(cfg, k, v)
    env = dict(os.environ) if env is None else env
    for name in dotted(cfg):
        value = env.get("CRAWLER_" + name.replace(".", "_").upper())
        if value is not None:
            put(cfg, name, value)
    for name, value in (flags or {}).items():
        put(cfg, name, value)
    validate(cfg)
    return cfg


def dotted(x: Any, prefix: str = "") -> list[str]:
    out = []
    for f in fields(x):
        v = getattr(x, f.name)
        out += dotted(v, f"{prefix}{f.name}.") if is_dataclass(v) else [prefix + f.name]
    return out


def put(cfg: Config, name: str, value: Any) -> None:
    *sections, key = name.split(".")
    at: Any = cfg
    for s in sections:
        at = getattr(at, s)
    _set(at, key, value)


def validate(cfg: Config) -> None:
    """Raises ValueError with all problems."""
    c, t, bad = cfg.crawler, cfg.content, []
    checks = [
        (c.max_pages > 0, "crawler.max_pages must be positive"), (c.max_depth >= 0, "crawler.max_depth must not be negative"), (c.concurrent_workers > 0, "crawler.concurrent_workers must be positive"),
        (c.global_rate_limit > 0 and c.per_host_rate_limit > 0, "rate limits must be positive"), (c.global_rate_burst > 0 and c.per_host_rate_burst > 0, "bursts must be positive"), (bool(c.user_agent), "crawler.user_agent is empty"),
        (0 <= t.quality_threshold <= 1, "content.quality_threshold must lie in 0..1"), (t.min_text_length >= 0, "content.min_text_length must not be negative"), (t.max_text_length > t.min_text_length, "content.max_text_length must exceed min_text_length"),
        (0 <= t.deduplication.similarity_threshold <= 1, "similarity_threshold must lie in 0..1"), (cfg.storage.type in STORES, f"storage.type must be one of {', '.join(STORES)}"), (cfg.frontier.queue_capacity >= 0, "frontier.queue_capacity must not be negative"),
    ]
    bad += [text for ok, text in checks if not ok]
    bad += [f"language {x} is not supported" for x in t.languages if x.lower() not in LANGUAGES]
    for p in [*c.include_patterns, *c.exclude_patterns]:
        try:
            re.compile(p)
        except re.error:
            bad.append(f"pattern {p!r} is not a regular expression")
    if bad:
        raise ValueError("; ".join(bad))


def extractor_options(cfg: Config):
    """Positive lengths and thresholds override the extractor's own, switches always do."""
    from .operators.extract import Options

    t, base = cfg.content, Options()
    pick = lambda v, d: v if v > 0 else d
    return Options(min_text_length=pick(t.min_text_length, base.min_text_length), max_text_length=pick(t.max_text_length, base.max_text_length), quality_threshold=pick(t.quality_threshold, base.quality_threshold), remove_boilerplate=t.remove_boilerplate, extract_main_content=t.extract_main_content, normalize_whitespace=t.normalize_whitespace)


def url_rules(cfg: Config):
    """User block-lists add to the loopback ones; the other lists replace the defaults."""
    from .functions.urls import LOCAL_HOSTS, Rules

    c = cfg.crawler
    return Rules(allow=c.allowed_domains, block=(*LOCAL_HOSTS, *c.blocked_domains), include=c.include_patterns, exclude=c.exclude_patterns)
