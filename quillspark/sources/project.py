"""Which files a project has: manifests, their products and members, modules, and what to skip."""

from __future__ import annotations

import glob
import os
import re
import tomllib
from dataclasses import dataclass, field

from ..operators.rustlex import modules

MANIFEST = "Cargo.toml"


@dataclass
class Found:
    """Origins in the order in which they were found, each once."""

    rust: list[str] = field(default_factory=list)
    markdown: list[str] = field(default_factory=list)
    descriptions: list[tuple[str, str]] = field(default_factory=list)

    def add(self, kind: str, path: str) -> None:
        own = getattr(self, kind)
        if path not in own:
            own.append(path)


def classify(path: str) -> str | None:
    """manifest, cmark, rust, or None for what is not read."""
    name = os.path.basename(path)
    return "manifest" if name == MANIFEST else "cmark" if name.endswith(".md") else "rust" if name.endswith(".rs") else None


@dataclass
class Ignored:
    """The patterns of the ignore files from a project's top (where .git is) down to a folder; the last that fits decides."""

    rules: list[tuple[str, re.Pattern, bool, bool]]

    def __contains__(self, path: str) -> bool:
        out, is_dir = False, os.path.isdir(path)
        for base, pattern, folders_only, keep in self.rules:
            if (is_dir or not folders_only) and pattern.fullmatch(os.path.relpath(path, base).replace(os.sep, "/")):
                out = not keep
        return out


def _pattern(text: str) -> re.Pattern:
    """A pattern of an ignore file; one with a slash inside begins at the file's folder, another fits at any depth."""
    anchored = "/" in text.rstrip("/")
    body = _expression(text.strip("/"))
    return re.compile(body if anchored else f"(?:.*/)?{body}")


def _expression(text: str) -> str:
    """As an expression: ** over folders, * and ? within one, [] as they are."""
    out, k = [], 0
    while k < len(text):
        if text.startswith("**/", k):
            out.append("(?:.*/)?")
            k += 3
        elif text.startswith("**", k):
            out.append(".*")
            k += 2
        elif text[k] == "[" and (e := text.find("]", k + 2)) > 0:
            inner = text[k + 1 : e].replace("\\", "\\\\")
            out.append(f"[{'^' + inner[1:] if inner[0] == '!' else inner}]")
            k = e + 1
        else:
            out.append("[^/]*" if text[k] == "*" else "[^/]" if text[k] == "?" else re.escape(text[k]))
            k += 1
    return "".join(out)


def ignored(folder: str) -> Ignored:
    folders, at = [], os.path.abspath(folder)
    while True:
        folders.append(at)
        up = os.path.dirname(at)
        if up == at or os.path.exists(os.path.join(at, ".git")):
            break
        at = up
    rules = []
    for base in reversed(folders):
        path = os.path.join(base, ".gitignore")
        if not os.path.isfile(path):
            continue
        with open(path, encoding="utf-8", errors="replace") as f:
            for line in map(str.rstrip, f):
                keep = line.startswith("!")
                text = line[1:] if keep else line.removeprefix("\\")
                if text.strip("/") and not line.startswith("#"):
                    rules.append((base, _pattern(text), text.endswith("/"), keep))
    return Ignored(rules)


def seed(folder: str) -> list[str]:
    """The Rust files directly in a folder that ignore files do not name."""
    patterns = ignored(folder)
    return [p for p in (os.path.join(folder, n) for n in sorted(os.listdir(folder)) if n.endswith(".rs")) if p not in patterns]


def products(manifest: str) -> list[str]:
    """The library and binaries of a manifest that are there."""
    root = os.path.dirname(manifest)
    with open(manifest, "rb") as f:
        told = tomllib.load(f)
    if "package" not in told:
        return []
    paths = [told.get("lib", {}).get("path", "src/lib.rs")]
    bins = [b["path"] for b in told.get("bin", []) if "path" in b] or ["src/main.rs"]
    found = [os.path.join(root, p) for p in [*bins, *paths]]
    found += sorted(glob.glob(os.path.join(root, "src/bin/*.rs")))
    return [p for p in dict.fromkeys(found) if os.path.isfile(p)]


def readme(manifest: str) -> str | None:
    """The readme a manifest names, or README.md beside it; relative to the manifest."""
    with open(manifest, "rb") as f:
        named = tomllib.load(f).get("package", {}).get("readme", "README.md")
    if not isinstance(named, str):
        return None
    path = os.path.join(os.path.dirname(manifest), named)
    return path if os.path.isfile(path) else None


def description(manifest: str) -> str | None:
    with open(manifest, "rb") as f:
        return tomllib.load(f).get("package", {}).get("description")


def members(manifest: str) -> list[str]:
    """The manifests of a workspace's members."""
    root = os.path.dirname(manifest)
    with open(manifest, "rb") as f:
        told = tomllib.load(f).get("workspace", {})
    gone = {os.path.normpath(os.path.join(root, p)) for e in told.get("exclude", []) for p in glob.glob(os.path.join(root, e)) or [os.path.join(root, e)]}
    out = []
    for pattern in told.get("members", []):
        for folder in sorted(glob.glob(os.path.join(root, pattern))):
            path = os.path.join(os.path.normpath(folder), MANIFEST)
            if os.path.isfile(path) and os.path.normpath(folder) not in gone:
                out.append(path)
    return out


def module_file(parent: str, name: str) -> str | None:
    """Where a module's source is; ValueError if it is at two places, None if at none."""
    folder, stem = os.path.dirname(parent), os.path.splitext(os.path.basename(parent))[0]
    there = [p for p in (os.path.join(folder, name, "mod.rs"), os.path.join(folder, f"{name}.rs"), os.path.join(folder, stem, f"{name}.rs")) if os.path.isfile(p)]
    if len(there) > 1:
        raise ValueError(f"module {name} of {parent} is at {len(there)} places")
    return there[0] if there else None


def closure(path: str, depth: int = 1 << 30) -> list[str]:
    """A source and the modules it declares, breadth first, down to a depth; sources that do not read or lex have none."""
    out, level = [path], [path]
    while level and depth > 0:
        nxt = []
        for p in level:
            try:
                with open(p, encoding="utf-8") as f:
                    names = modules(f.read())
                found = [m for m in (module_file(p, n) for n in names) if m]
            except (OSError, ValueError):
                continue
            nxt += [m for m in found if m not in out and m not in nxt]
        out += nxt
        level, depth = nxt, depth - 1
    return out


def extract(paths: list[str], recurse: bool = False, skip_readme: bool = False, descriptions: bool = False, depth: int = 1 << 30) -> Found:
    """The origins that paths lead to; no paths: the working folder, recursively."""
    if not paths:
        paths, recurse = [os.getcwd()], True
    found = Found()

    def manifest(path: str) -> None:
        for p in products(path):
            for m in closure(p, depth):
                found.add("rust", m)
        if not skip_readme and (r := readme(path)):
            found.add("markdown", r)
        if descriptions and (d := description(path)):
            found.descriptions.append((path, d))
        for m in members(path):
            for p in products(m):
                for x in closure(p, depth):
                    found.add("rust", x)

    def folder(path: str) -> None:
        if os.path.isfile(own := os.path.join(path, MANIFEST)):
            manifest(own)
            return
        patterns = ignored(path)
        for n in sorted(os.listdir(path)):
            child = os.path.join(path, n)
            if n.startswith(".") or child in patterns:
                continue
            if os.path.isdir(child):
                recurse and folder(child)
            else:
                file(child, False)

    def file(path: str, follow: bool) -> None:
        kind = classify(path)
        if kind == "manifest":
            manifest(path)
        elif kind == "cmark":
            found.add("markdown", path)
        elif kind == "rust":
            for m in closure(path, depth) if follow else [path]:
                found.add("rust", m)

    for p in (os.path.realpath(p) for p in paths):
        if os.path.isdir(p):
            folder(p)
        elif os.path.isfile(p):
            file(p, recurse)
    return found
