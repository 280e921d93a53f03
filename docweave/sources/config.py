"""Configuration: TOML sections become namespaces; what is wrong with them becomes messages."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field

from ..functions import globs
from ..model import Namespace

CONFIG_NAME = "docweave.toml"
USER_DIR = os.path.join("~", ".docweave", "namespaces")
#: Sections that are no namespaces.
RESERVED = ("ignore", "references", "roles", "sources", "rules", "project")
_KEYS = {"paths", "rules", "owner", "summary", "linked_by", "briefing", "takes_members"}
_BRIEFING = {"statuses", "counts", "findings"}

#: Rules that a namespace without configuration gets.
ZERO_CONFIG = ["core.frontmatter", "core.id", "core.id-unique", "core.dep-resolved", "core.dep-cycle", "core.cross-ref", "core.link-resolved"]


class ConfigError(Exception):
    """Kernel error: the run ends with status 2."""


@dataclass
class Config:
    namespaces: list[Namespace] = field(default_factory=list)
    ignore_patterns: list[str] = field(default_factory=list)
    ignore_namespaces: list[str] = field(default_factory=list)
    scan: list[str] = field(default_factory=list)
    roles: list[str] | None = None
    sources: dict[str, dict] = field(default_factory=dict)
    zero: bool = False
    #: (severity, code, subject) of messages about the configuration
    messages: list[tuple[str, str, str]] = field(default_factory=list)

    def names(self) -> list[str]:
        return [n.name for n in self.namespaces]


def find(start: str) -> str | None:
    """The nearest configuration at or above a folder."""
    at = os.path.abspath(start)
    while True:
        if os.path.isfile(os.path.join(at, CONFIG_NAME)):
            return os.path.join(at, CONFIG_NAME)
        if at == os.path.dirname(at):
            return None
        at = os.path.dirname(at)


def _namespace(name: str, section: dict, config: Config) -> Namespace:
    out = Namespace(name)
    for key, value in section.items():
        if isinstance(value, dict) and "." in key:
            out.params[key] = value
        elif key in _KEYS:
            setattr(out, key, value)
        else:
            config.messages.append(("warning", "cfg.key-unknown", f"{name}.{key}"))
    for path in list(out.paths):
        if not globs.valid(path):
            config.messages.append(("error", "cfg.paths-invalid", f"{name}: {path}"))
            out.paths.remove(path)
    return out


def parse(text: str, user: dict[str, str] | None = None) -> Config:
    """Configuration from TOML; ``user`` maps a namespace to the TOML that replaces its section whole."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"the configuration is no TOML: {e}") from e
    for name, own in (user or {}).items():
        raw[name] = tomllib.loads(own).get(name, {})
    config = Config(
        ignore_patterns=raw.get("ignore", {}).get("patterns", []),
        ignore_namespaces=raw.get("ignore", {}).get("namespaces", []),
        scan=raw.get("references", {}).get("scan", []),
        roles=raw.get("roles", {}).get("allowed"),
        sources=raw.get("sources", {}),
    )
    for name, section in raw.items():
        if name not in RESERVED and isinstance(section, dict):
            config.namespaces.append(_namespace(name, section, config))
    return config


def load(root: str, user_dir: str = USER_DIR) -> Config:
    """The configuration for a root; without any file, the zero configuration."""
    path = find(root)
    if path is None:
        return Config(zero=True)
    folder = os.path.expanduser(user_dir)
    user = {}
    if os.path.isdir(folder):
        for name in sorted(os.listdir(folder)):
            if name.endswith(".toml"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    user[name[:-5]] = f.read()
    with open(path, encoding="utf-8") as f:
        return parse(f.read(), user)


def validate(config: Config, registry: dict, providers=lambda code: []) -> None:
    """Rule bindings against the registry: unknown codes warn and are dropped, missing tables end the run.

    ``providers`` names the packs that bring a rule.
    """
    for n in config.namespaces:
        for code in list(n.rules):
            rule = registry.get(code)
            if rule is None:
                if not code.startswith(("core.", "cfg.")) and rule_dirs(code, config):
                    continue
                packs = "".join(f", the pack {p} has it" for p in providers(code)[:1])
                config.messages.append(("warning", "cfg.rule-unknown", f"{n.name}: {code}{packs}"))
                n.rules.remove(code)
            elif rule.needs and not n.params.get(code):
                raise ConfigError(f"{n.name}: {code} needs a table of parameters")
            elif rule.inert and rule.inert(n, n.params.get(code, {})):
                config.messages.append(("error" if not n.paths else "warning", "cfg.rule-inert", f"{n.name}: {code}"))
            elif code == "core.min-docs" and n.params.get(code, {}).get("count", 1) != 1:
                config.messages.append(("error", "cfg.reserved-param", f"{n.name}: {code}.count"))
            elif code == "core.metadata-format":
                bad = {k: v for k, v in n.params[code].items() if k != "severity" and v not in ("date", "datetime")}
                if bad:
                    raise ConfigError(f"{n.name}: {code} knows date and datetime, not {sorted(bad.values())}")
        if n.briefing:
            allowed = n.params.get("core.allowed-values", {}).get("status")
            for key, entries in list(n.briefing.items()):
                if key not in _BRIEFING:
                    config.messages.append(("error", "cfg.briefing-invalid", f"{n.name}.briefing.{key}"))
                    del n.briefing[key]
                    continue
                ok = (allowed if key != "findings" else n.rules) if key == "findings" or allowed else entries
                for e in [e for e in entries if e not in ok]:
                    config.messages.append(("error", "cfg.briefing-invalid", f"{n.name}.briefing.{key}: {e}"))
                    entries.remove(e)


def rule_dirs(code: str, config: Config) -> bool:
    """Whether an external rule of that code was found; filled in by discovery."""
    return code in getattr(config, "external", {})
