"""Settings: a TOML file or defaults, and where it is looked for."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, fields

from ..functions.words import SPLIT_CHARS

CHECKERS = {"hunspell": "hunspell", "zet": "zspell", "zspell": "zspell", "spellbook": "spellbook", "book": "spellbook", "nlprules": "nlprules", "reflow": "reflow"}
LANGUAGE = re.compile(r"[a-z]{2}_[A-Z]{2}")


@dataclass
class Quirks:
    transform_regex: list[str] = field(default_factory=list)
    allow_concatenation: bool = False
    allow_dashes: bool = False
    allow_emojis: bool = True
    check_footnote_references: bool = False


@dataclass
class Spelling:
    lang: str = "en_US"
    search_dirs: list[str] = field(default_factory=list)
    skip_os_lookups: bool = False
    use_builtin: bool = True
    extra_dictionaries: list[str] = field(default_factory=list)
    tokenization_splitchars: str = SPLIT_CHARS
    quirks: Quirks = field(default_factory=Quirks)


@dataclass
class Grammar:
    override_rules: str | None = None
    override_tokenizer: str | None = None


@dataclass
class Reflow:
    max_line_length: int = 80


@dataclass
class Config:
    dev_comments: bool = False
    skip_readme: bool = False
    hunspell: Spelling | None = field(default_factory=Spelling)
    zspell: Spelling | None = None
    spellbook: Spelling | None = None
    nlprules: Grammar | None = None
    reflow: Reflow | None = None

    def enabled(self) -> list[str]:
        return [n for n in ("hunspell", "zspell", "spellbook", "nlprules", "reflow") if getattr(self, n) is not None]


_SECTIONS = {"hunspell": Spelling, "zspell": Spelling, "zet": Spelling, "spellbook": Spelling, "nlprules": Grammar, "reflow": Reflow}


def _make(kind, told: dict, strict: bool = True):
    """A section from its table; keys in any case; unknown ones are an error where strict."""
    known = {f.name for f in fields(kind)}
    out = {}
    for k, v in told.items():
        name = {"allow_dashed": "allow_dashes"}.get(k.lower(), k.lower())
        if name not in known:
            if strict:
                raise ValueError(f"unknown setting {k}")
            continue
        out[name] = _make(Quirks, v, strict=False) if name == "quirks" else v
    if kind is Spelling and not LANGUAGE.fullmatch(out.get("lang", "en_US")):
        raise ValueError(f"no language: {out['lang']}")
    return kind(**out)


def parse(text: str, folder: str = ".") -> Config:
    """Settings of a TOML text; relative folders are seen from folder."""
    config = Config()
    told = tomllib.loads(text)
    named = {k.lower() for k in told}
    if named & set(_SECTIONS):
        config.hunspell = None
    for k, v in told.items():
        name = k.lower()
        if name in ("dev_comments", "skip_readme"):
            setattr(config, name, v)
        elif name in _SECTIONS:
            section = _make(_SECTIONS[name], v, strict=name != "reflow")
            if isinstance(section, Spelling):
                section.search_dirs = [os.path.normpath(os.path.join(folder, d)) for d in section.search_dirs]
            if isinstance(section, Grammar) and section.override_rules:
                section.override_rules = os.path.normpath(os.path.join(folder, section.override_rules))
            setattr(config, "zspell" if name == "zet" else name, section)
        else:
            raise ValueError(f"unknown section {k}")
    return config


def masked(config: Config, checkers: str | None) -> Config:
    """Only the named checkers (comma separated), with defaults where they have no section; without names, the first alone."""
    names = [CHECKERS[c.strip().lower()] for c in checkers.split(",")] if checkers else ["hunspell"]
    kinds = {"hunspell": Spelling, "zspell": Spelling, "spellbook": Spelling, "nlprules": Grammar, "reflow": Reflow}
    for n, kind in kinds.items():
        setattr(config, n, (getattr(config, n) or kind()) if n in names else None)
    return config


def to_toml(config: Config) -> str:
    """Settings as TOML."""

    def value(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return "[" + ", ".join(map(value, v)) + "]"
        if isinstance(v, str):
            return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
        return str(v)

    def table(name: str, x) -> list[str]:
        own = [(f.name, getattr(x, f.name)) for f in fields(x)]
        lines = [f"[{name}]"] + [f"{k} = {value(v)}" for k, v in own if v is not None and not hasattr(v, "__dataclass_fields__")]
        for k, v in own:
            if hasattr(v, "__dataclass_fields__"):
                lines += ["", *table(f"{name}.{k}", v)]
        return lines

    lines = [f"dev_comments = {value(config.dev_comments)}", f"skip_readme = {value(config.skip_readme)}"]
    for n in config.enabled():
        lines += ["", *table(n, getattr(config, n))]
    return "\n".join(lines) + "\n"


def write(config: Config, path: str) -> None:
    """Writes settings to a file that must not exist."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "x", encoding="utf-8") as f:
        f.write(to_toml(config))


def full() -> Config:
    """Every section with its defaults."""
    return Config(hunspell=Spelling(), zspell=Spelling(), spellbook=Spelling(), nlprules=Grammar(), reflow=Reflow())


def user_path(home: str | None = None) -> str:
    return os.path.join(home or os.path.expanduser("~"), ".config", "quillspark", "config.toml")


def find(explicit: str | None = None, target: str | None = None, cwd: str = ".", home: str | None = None) -> Config:
    """The first settings there are: named file, metadata of the target's and the working folder's manifest, .config of the working folder, of the user; else defaults."""
    if explicit:
        with open(explicit, encoding="utf-8") as f:
            return parse(f.read(), os.path.dirname(explicit))
    for folder in [d for d in (target, cwd) if d]:
        manifest = os.path.join(folder, "Cargo.toml")
        if os.path.isfile(manifest):
            with open(manifest, "rb") as f:
                told = tomllib.load(f)
            meta = (told.get("package") or told.get("workspace") or {}).get("metadata", {}).get("spellcheck", {})
            if "config" in meta:
                return find(os.path.join(folder, meta["config"]))
    for path in (os.path.join(cwd, ".config", "spellcheck.toml"), user_path(home)):
        if os.path.isfile(path):
            return find(path)
    return Config()


def dictionary_paths(lang: str, search_dirs: list[str], skip_os_lookups: bool = False, os_dirs: tuple[str, ...] = ("/usr/share/hunspell", "/usr/share/myspell", "/usr/share/myspell/dicts")) -> tuple[str, str] | None:
    """(.dic, .aff) in the first folder that has both; the user's folders come first."""
    for d in [*search_dirs, *(() if skip_os_lookups else os_dirs)]:
        pair = os.path.join(d, f"{lang}.dic"), os.path.join(d, f"{lang}.aff")
        if all(map(os.path.isfile, pair)):
            return pair
    return None
