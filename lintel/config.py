"""Configuration: TOML read on the driver into frozen objects, which become literals in the plans."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path
from types import MappingProxyType
from typing import Any

MIB = 1 << 20


class ConfigError(ValueError):
    """The configuration cannot be read, or contradicts itself."""


@dataclass(frozen=True)
class KeywordSet:
    keywords: tuple[str, ...] = ()
    info: str = ""
    disallowed_names: tuple[str, ...] = ()


@dataclass(frozen=True)
class TestConfig:
    """Which files a check looks at, and for what. Only one of the two lists may have entries."""

    blacklist: tuple[str, ...] = ()
    whitelist: tuple[str, ...] = ()
    arguments: tuple[KeywordSet, ...] = ()

    __test__ = False


@dataclass(frozen=True)
class General:
    max_archive_file_size: int = 10 * MIB
    max_total_archive_memory: int = 100 * MIB
    max_content_scan_file_size: int = 1024 * MIB
    #: Beyond it, keyword findings of a text come one by one.
    large_text_bytes: int = MIB


@dataclass(frozen=True)
class Config:
    general: General = General()
    tests: Mapping[str, TestConfig] = field(default_factory=dict)
    operations: Mapping[str, str] = field(default_factory=dict)
    collectors: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)

    def test(self, name: str) -> TestConfig:
        """A check's section; archives' keyword check takes that of files. Without a section nothing is filtered."""
        return self.tests.get("IsFreeOfKeywords" if name == "IsArchiveFreeOfKeywords" else name, TestConfig())

    def collector(self, name: str) -> Mapping[str, Any]:
        return self.collectors.get(name, MappingProxyType({}))

    def with_collector(self, name: str, **attrs: Any) -> Config:
        """A copy; the configuration that others share stays as it is."""
        return replace(self, collectors={**self.collectors, name: {**self.collector(name), **attrs}})


def _strings(value: Any) -> tuple[str, ...]:
    return tuple(x for x in value if isinstance(x, str)) if isinstance(value, list) else ()


def _section(raw: Mapping[str, Any], name: str) -> Mapping[str, Any]:
    value = raw.get(name)
    return value if isinstance(value, dict) else {}


def _test(value: Any) -> TestConfig:
    if not isinstance(value, dict):
        return TestConfig()
    sets = [x for x in value.get("keywordArguments", ()) if isinstance(x, dict)] if isinstance(value.get("keywordArguments"), list) else []
    arguments = tuple(KeywordSet(_strings(x.get("keywords")), x["info"] if isinstance(x.get("info"), str) else "", _strings(x.get("disallowed_names"))) for x in sets)
    return TestConfig(_strings(value.get("blacklist")), _strings(value.get("whitelist")), arguments)


def parse(text: str) -> Config:
    """Unknown keys and values of a wrong kind are ignored."""
    raw = tomllib.loads(text)
    number = {k: v for k, v in _section(raw, "general").items() if isinstance(v, int) and not isinstance(v, bool)}
    base = General()
    general = General(
        number.get("maxArchiveFileSize", base.max_archive_file_size),
        number.get("maxTotalArchiveMemory", base.max_total_archive_memory),
        number.get("maxContentScanFileSize", base.max_content_scan_file_size),
    )
    collectors = {}
    for name, value in _section(raw, "collector").items():
        attrs = _section(value, "attrs") if isinstance(value, dict) else {}
        collectors[name] = {k: list(_strings(v)) if isinstance(v, list) else v for k, v in attrs.items() if isinstance(v, str | bool | list)}
    operations = {k: v["collector"] if isinstance(v, dict) and isinstance(v.get("collector"), str) else "" for k, v in _section(raw, "operation").items()}
    return Config(general, {k: _test(v) for k, v in _section(raw, "test").items()}, operations, collectors)


def validate(config: Config) -> Config:
    for name, test in config.tests.items():
        if test.blacklist and test.whitelist:
            raise ConfigError(f"error in test {name}: it has a blacklist and a whitelist; at most one of them may have entries")
    return config


def load(path: str | Path) -> Config:
    try:
        text = Path(path).read_text(encoding="utf-8")
        return validate(parse(text))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(f"failed to parse config file '{path}': {e}") from e


def find() -> Path | None:
    """The first configuration file among ~/pc.toml, ./pc.toml and ~/.config/pc.toml."""
    for path in ("~/pc.toml", "./pc.toml", "~/.config/pc.toml"):
        if (p := Path(path).expanduser()).exists():
            return p
    return None
