"""Layered settings: app.yaml, then local.yaml, then LODE__SECTION__KEY variables; ${VAR} and ${VAR:-default} are filled in."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, get_type_hints

import yaml

from lodeframe.engine import Limits

PREFIX = "LODE__"
SECRET = re.compile(r"password|secret|token|api_?key|credential|connection_string", re.IGNORECASE)
FOLDER = "LODE_CONFIG"  # the variable that names the folder of settings
_VARIABLE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


class ConfigError(ValueError):
    """A setting that is unknown, of the wrong kind, or refers to a missing variable."""


@dataclass(frozen=True)
class Paths:
    data_root: str = "data"
    catalog: str = "data/catalog"
    docs: str = "docs"


@dataclass(frozen=True)
class Storage:
    backend: str = "local"


@dataclass(frozen=True)
class CatalogSettings:
    busy_timeout_seconds: float = 10.0
    history_limit: int = 5


@dataclass(frozen=True)
class Logging:
    level: str = "INFO"
    format: str = "console"
    file: str | None = None


@dataclass(frozen=True)
class Config:
    environment: str = "dev"
    paths: Paths = field(default_factory=Paths)
    storage: Storage = field(default_factory=Storage)
    catalog: CatalogSettings = field(default_factory=CatalogSettings)
    query: Limits = field(default_factory=Limits)
    logging: Logging = field(default_factory=Logging)
    datasets: dict = field(default_factory=dict)
    base: str = "."

    def path(self, name: str) -> Path:
        """A path setting; relative ones count from the folder above the settings."""
        p = Path(getattr(self.paths, name))
        return p if p.is_absolute() else Path(self.base) / p


def deep_merge(a: dict, b: Mapping) -> dict:
    """a with b's values over it, section by section; a section can't become a value, nor a value a section."""
    out = dict(a)
    for k, v in b.items():
        if k in out and out[k] is not None and v is not None and isinstance(out[k], Mapping) != isinstance(v, Mapping):
            raise ConfigError(f"{k} is a section in one place and a value in another")
        out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def overrides(env: Mapping[str, str]) -> dict:
    """Settings from LODE__SECTION__KEY variables, read as YAML."""
    out: dict = {}
    for name in sorted(env):
        if name.startswith(PREFIX):
            at, keys = out, name[len(PREFIX) :].lower().split("__")
            for k in keys[:-1]:
                at = at.setdefault(k, {})
                if not isinstance(at, dict):
                    raise ConfigError(f"{name}: {k} has a value already")
            if isinstance(at.get(keys[-1]), dict):
                raise ConfigError(f"{name}: {keys[-1]} is a section already")
            at[keys[-1]] = yaml.safe_load(env[name])
    return out


def filled(value: Any, env: Mapping[str, str]) -> Any:
    """value with its variables put in; a value that is one variable and nothing else takes the YAML type of its text."""
    match value:
        case Mapping():
            return dict(zip(value, filled(list(value.values()), env), strict=True))
        case list():
            return [filled(v, env) for v in value]
        case str() if found := list(_VARIABLE.finditer(value)):
            return _put_in(value, found, env)
    return value


def _put_in(value: str, found: list[re.Match], env: Mapping[str, str]) -> Any:
    known = {m[1]: env.get(m[1]) or m[2] for m in found}
    if missing := [name for name, text in known.items() if text is None]:
        raise ConfigError(f"{value!r} needs the variable {', '.join(missing)}: it is not set and has no default")
    if found[0][0] == value:
        return yaml.safe_load(known[found[0][1]])
    return _VARIABLE.sub(lambda m: env.get(m[1]) or m[2], value)


def dotenv(path: Path) -> dict[str, str]:
    if not path.is_file():
        return {}
    pairs = (m.groups() for line in path.read_text(encoding="utf-8").splitlines() if (m := re.match(r"\s*(?:export\s+)?(\w+)\s*=\s*(.*?)\s*$", line)))
    return {k: v[1:-1] if v[:1] == v[-1:] and v[:1] in ("'", '"') and len(v) > 1 else v for k, v in pairs}


def _built(kind: type, found: Any, where: str) -> Any:
    if not isinstance(found, Mapping):
        raise ConfigError(f"{where or 'settings'}: expected a section")
    known, hints = {f.name for f in fields(kind)} - {"base"}, get_type_hints(kind)
    if extra := sorted(set(found) - known):
        raise ConfigError(f"{where or 'settings'}: unknown setting {', '.join(extra)}")
    out = {}
    for k, v in found.items():
        name, hint = f"{where}.{k}".strip("."), hints[k]
        if is_dataclass(hint):
            out[k] = _built(hint, v or {}, name)
            continue
        if hint is float and isinstance(v, int) and not isinstance(v, bool):
            v = float(v)
        fits = isinstance(v, hint) if hint is not dict else isinstance(v, Mapping)
        if not fits or isinstance(v, bool) and hint in (int, float):
            raise ConfigError(f"{name}: {v!r} is not {getattr(hint, '__name__', hint)}")
        if hint in (int, float) and v <= 0:
            raise ConfigError(f"{name} must be positive")
        out[k] = v
    return kind(**out)


def find_folder(start: Path | None = None) -> Path | None:
    """The nearest folder `config` that holds app.yaml, from start upwards."""
    at = (start or Path.cwd()).absolute()
    return next((p / "config" for p in (at, *at.parents) if (p / "config" / "app.yaml").is_file()), None)


def load_config(folder: str | Path | None = None, env: Mapping[str, str] | None = None) -> Config:
    real = dict(os.environ if env is None else env)
    if not folder and (named := real.get(FOLDER)):
        if not Path(named).is_dir():
            raise ConfigError(f"{FOLDER} names {named}, which is no folder")
        folder = named
    folder = Path(folder) if folder else find_folder()
    base = folder.absolute().parent if folder else Path.cwd()
    env = dotenv(base / ".env") | real
    found: dict = {}
    for name in ("app.yaml", "local.yaml"):
        if folder and (folder / name).is_file():
            layer = yaml.safe_load((folder / name).read_text(encoding="utf-8")) or {}
            if not isinstance(layer, Mapping):
                raise ConfigError(f"{name} must hold sections")
            found = deep_merge(found, layer)
    if folder and (folder / "datasets.yaml").is_file():
        found = deep_merge(found, {"datasets": yaml.safe_load((folder / "datasets.yaml").read_text(encoding="utf-8")) or {}})
    config = _built(Config, filled(deep_merge(found, overrides(env)), env), "")
    return Config(**{f.name: getattr(config, f.name) for f in fields(config)} | {"base": str(base)})


def redacted(config: Config | Mapping) -> dict:
    """Settings with the values of secret-looking keys hidden."""
    found = asdict(config) if is_dataclass(config) else dict(config)
    return {k: redacted(v) if isinstance(v, Mapping) else "***" if SECRET.search(k) and v is not None else v for k, v in found.items()}
