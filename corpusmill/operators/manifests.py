"""Direct dependencies that a repository's manifests name."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.sources import files

Found = Iterator[tuple[str, str | None, str]]
#: Manifests by language, in the order in which they are read.
ORDER = {
    "Python": [r"^requirements[^/]*\.txt$", r"^requirements/[^/]*\.txt$", r"^pyproject\.toml$", r"^setup\.cfg$"],
    "JavaScript": [r"^package\.json$"],
    "Java": [r"^pom\.xml$", r"^[^/]+/pom\.xml$"],
    "C++": [r"^conanfile\.txt$", r"^vcpkg\.json$", r"^CMakeLists\.txt$"],
}
# Names that find_package() calls do not count.
NOT_PACKAGES = ["CMAKE", "THREADS", "PKGCONFIG"]
_NAME = r"[A-Za-z0-9_.\-]+"
_NUMERIC = re.compile(rf"({_NAME})\s*([><=!~^,\s\d.*]+)?")
_WORDY = re.compile(rf"({_NAME})\s*([><=!~^,\s\d.*a-zA-Z]+)?")


def _requirement(text: str, pattern: re.Pattern, kind: str = "main") -> Found:
    m = pattern.match(re.sub(r"\[[^\]]*\]", "", text).strip())
    if m:
        yield m[1].strip(), (m[2] or "").strip() or None, kind


def requirements(text: str) -> Found:
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#-":
            yield from _requirement(line.split("#")[0].strip(), _NUMERIC)


def _listed(text: str, key: str) -> str | None:
    """What stands in the brackets after ``key =``, brackets in quotes aside."""
    m = re.search(rf"{key}\s*=\s*\[", text)
    depth, at, end = 1, m.end() if m else len(text), None
    for t in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[\]]', text[at:], re.S):
        depth += (t[0] == "[") - (t[0] == "]")
        if depth == 0:
            end = at + t.start()
            break
    return text[at:end] if end is not None else None


def pyproject(text: str) -> Found:
    try:
        data = tomllib.loads(text)
        project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
        out = [x for d in project.get("dependencies", []) for x in _requirement(d, _WORDY)]
        out += [x for group in project.get("optional-dependencies", {}).values() for d in group for x in _requirement(d, _WORDY, "optional")]
        for part, kind in (("dependencies", "main"), ("dev-dependencies", "dev")):
            for name, spec in poetry.get(part, {}).items():
                if kind == "dev" or name.lower() != "python":
                    out.append((name, spec if isinstance(spec, str) else spec.get("version") if isinstance(spec, dict) else None, kind))
        yield from out
    except (ValueError, AttributeError, TypeError):
        for d in re.findall(r'"([^"]+)"', _listed(text, "dependencies") or ""):
            yield from _requirement(d, _NUMERIC)


def setup_cfg(text: str) -> Found:
    if m := re.search(r"install_requires\s*=\s*((?:\n\s+[^\n]+)+)", text):
        for line in m[1].strip().splitlines():
            yield from _requirement(line.strip(), _NUMERIC)


def package_json(text: str) -> Found:
    data = json.loads(text)
    for part, kind in (("dependencies", "main"), ("devDependencies", "dev"), ("peerDependencies", "optional")):
        for name, version in data.get(part, {}).items():
            yield name, version if version is None or isinstance(version, str) else json.dumps(version), kind


def pom(text: str) -> Found:
    for block in re.findall(r"<dependency>(.*?)</dependency>", text, re.S):
        part = {k: m[1].strip() for k in ("groupId", "artifactId", "version", "scope") if (m := re.search(f"<{k}>(.*?)</{k}>", block))}
        if "groupId" in part and "artifactId" in part:
            yield f"{part['groupId']}:{part['artifactId']}", part.get("version"), "dev" if part.get("scope", "").lower() in ("test", "provided") else "main"


def conanfile(text: str) -> Found:
    section = ""
    for line in map(str.strip, text.splitlines()):
        if line.startswith("["):
            section = line.lower()
        elif section == "[requires]" and (m := re.match(rf"({_NAME})/(\S+)", line)):
            yield m[1], m[2], "main"


def vcpkg(text: str) -> Found:
    for d in json.loads(text).get("dependencies", []):
        if isinstance(d, str):
            yield d, None, "main"
        elif isinstance(d, dict):
            yield d.get("name", ""), d.get("version-semver") or d.get("version"), "main"


def cmake(text: str) -> Found:
    for name in re.findall(r"(?i)find_package\s*\(\s*(\w+)", text):
        if name.upper() not in NOT_PACKAGES:
            yield name, None, "main"


def parser_of(path: str):
    name = path.rsplit("/", 1)[-1]
    return {"pyproject.toml": pyproject, "setup.cfg": setup_cfg, "package.json": package_json, "pom.xml": pom, "conanfile.txt": conanfile, "vcpkg.json": vcpkg, "CMakeLists.txt": cmake}.get(name, requirements)


def rank(path: Column, language: str) -> Column:
    """Place of a path among its language's manifests; null if it is none."""
    out = F.lit(None).cast("int")
    for i, pattern in reversed(list(enumerate(ORDER[language]))):
        out = F.when(path.rlike(pattern), i).otherwise(out)
    return out


def dependencies(tree: DataFrame, language: str) -> DataFrame:
    """repo, position, name, version, kind: what the manifests list, in reading order; a broken manifest lists nothing more."""
    found = tree.select("repo", "path", "content", rank(F.col("path"), language).alias("rank")).filter("rank IS NOT NULL")
    if language == "Java":  # one file a repository: at the root, else the first one level down
        found = found.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("rank", "path"))).filter("n = 1").drop("n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for repo, path, order, text in zip(batch["repo"], batch["path"], batch["rank"], batch["text"]):
                items: list = []
                try:
                    items.extend(parser_of(path)(text))
                except (ValueError, AttributeError, TypeError, KeyError):
                    pass
                rows += [(repo, order, path, i, *x) for i, x in enumerate(items)]
            yield pd.DataFrame(rows, columns=["repo", "rank", "path", "i", "name", "version", "kind"])

    rows = found.select("repo", "path", "rank", files.decoded(F.col("content")).alias("text")).mapInPandas(run, "repo string, rank int, path string, i int, name string, version string, kind string")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("repo").orderBy("rank", "path", "i"))).select("repo", "position", "name", "version", "kind")


def dependency_edges(rows: DataFrame) -> DataFrame:
    """repo, name, version of each distinct name that is not empty, the first one's version or ``latest``."""
    first = rows.filter("name <> ''").groupBy("repo", "name").agg(F.min_by(F.struct("version"), "position").alias("v"))
    return first.select("repo", "name", F.coalesce("v.version", F.lit("latest")).alias("version"))
