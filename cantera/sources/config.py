"""Settings: defaults, a YAML file, and the environment, in this order."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any

from cantera.plans.vocab import CONFIGURED_MOODS

PREFIX = "CANTERA_"


@dataclass(frozen=True)
class Catalog:
    path: str = ""
    library_name: str = "Music"


@dataclass(frozen=True)
class TagApi:
    api_key: str = ""
    api_secret: str = ""


@dataclass(frozen=True)
class Mapping:
    target_moods: tuple[str, ...] = CONFIGURED_MOODS
    threshold: float = 0.45
    genre_threshold: float = 0.45
    subgenre_threshold: float = 0.65
    mood_threshold: float = 0.45


@dataclass(frozen=True)
class Processing:
    batch_size: int = 100
    dry_run: bool = False
    overwrite: bool = False
    path_map_source: str = ""
    path_map_target: str = ""


@dataclass(frozen=True)
class Audio:
    enabled: bool = True
    models_dir: str = "models"
    model_filename: str = ""
    threshold: float = 0.1


@dataclass(frozen=True)
class Command:
    enabled: bool = False
    binary_path: str = "beet"


@dataclass(frozen=True)
class Switch:
    enabled: bool = True


@dataclass(frozen=True)
class Releases:
    api_token: str = ""


@dataclass(frozen=True)
class State:
    path: str = "data/state"


@dataclass(frozen=True)
class Settings:
    catalog: Catalog = field(default_factory=Catalog)
    tags: TagApi = field(default_factory=TagApi)
    recordings: Switch = field(default_factory=Switch)
    releases: Releases = field(default_factory=Releases)
    mapping: Mapping = field(default_factory=Mapping)
    processing: Processing = field(default_factory=Processing)
    audio: Audio = field(default_factory=Audio)
    command: Command = field(default_factory=Command)
    files: Switch = field(default_factory=Switch)
    state: State = field(default_factory=State)


def parsed(value: str) -> Any:
    """true and false, whole numbers, else the text itself."""
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    return int(value) if value.isdigit() else value


def load(path: str | None = None, environment: dict[str, str] | None = None) -> Settings:
    """Unknown sections and keys are ignored; a missing file leaves the defaults."""
    given: dict[str, dict] = {}
    if path and Path(path).is_file():
        import yaml

        content = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        given = {k: dict(v) for k, v in content.items() if isinstance(v, dict)} if isinstance(content, dict) else {}
    for name, value in (os.environ if environment is None else environment).items():
        section, _, key = name.removeprefix(PREFIX).lower().partition("_")
        if name.startswith(PREFIX) and key:
            given.setdefault(section, {})[key] = parsed(value)
    settings = Settings()
    for f in fields(settings):
        section = getattr(settings, f.name)
        if is_dataclass(section) and f.name in given:
            known = {x.name for x in fields(section)}
            values = {k: tuple(v) if isinstance(v, list) else v for k, v in given[f.name].items() if k in known}
            settings = replace(settings, **{f.name: replace(section, **values)})
    return settings


def save(answers: dict[str, dict], path: str) -> None:
    """Merges answers into a YAML file section by section; other content and order stay."""
    import yaml

    file = Path(path)
    content = (yaml.safe_load(file.read_text(encoding="utf-8")) or {}) if file.is_file() else {}
    for section, values in answers.items():
        content.setdefault(section, {}).update(values)
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(yaml.safe_dump(content, sort_keys=False, allow_unicode=True), encoding="utf-8")


def masked(token: str) -> str:
    """A secret as it may be shown: its first and last four characters."""
    return f"{token[:4]}…{token[-4:]}" if len(token) > 8 else "*" * len(token)


def as_dict(settings: Settings) -> dict:
    return asdict(settings)


#: Asked for by the wizard: what it says, where the answer goes, and whether it is secret.
QUESTIONS = (
    ("Catalogue of tracks (path)", "catalog", "path", False),
    ("Name of the music library", "catalog", "library_name", False),
    ("Key of the tag service", "tags", "api_key", True),
    ("Tracks a batch", "processing", "batch_size", False),
    ("Least similarity of a tag and a mood", "mapping", "threshold", False),
    ("Folder of the music as the catalogue names it", "processing", "path_map_source", False),
    ("The same folder on this machine", "processing", "path_map_target", False),
    ("Moods, separated by commas", "mapping", "target_moods", False),
)


def wizard(path: str, ask: Callable[[str], str] = input) -> dict[str, dict]:
    """Asks for the main settings, an empty answer keeping what is there, and saves them.

    Secrets are shown masked. Numbers that are none are asked for again.
    """
    settings, answers = load(path, {}), {}
    for question, section, key, secret in QUESTIONS:
        now = getattr(getattr(settings, section), key)
        shown = ", ".join(now) if isinstance(now, tuple) else masked(now) if secret and now else str(now)
        while True:
            answer = ask(f"{question} [{shown}]: ").strip()
            try:
                if not answer or answer == shown:
                    value = list(now) if isinstance(now, tuple) else now
                elif isinstance(now, tuple):
                    value = [m.strip() for m in answer.split(",") if m.strip()] or list(now)
                else:
                    value = type(now)(answer)
                break
            except ValueError:
                continue
        answers.setdefault(section, {})[key] = value
    save(answers, path)
    return answers
