"""Facts about source repositories as statements, and line findings.

Files come as (path, content) rows, from ``spark.read.text(..., wholetext=True)`` or any table. Rust and
JavaScript are read by regular expressions: items, imports and calls by line, not a full syntax tree.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import model as m

CODE, SECURITY = "urn:code:", "urn:sec:"
LANGUAGES = {".rs": "rust", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python", ".json": "json", ".toml": "toml", ".md": "markdown", ".html": "html"}
_ROWS = "s string, p string, o string, o_dt string, o_lang string"
_ITEM = {"fn": "Function", "struct": "Struct", "enum": "Enum", "trait": "Trait", "impl": "Implementation"}


def findings(files: DataFrame, cap: int | None = None) -> DataFrame:
    """The files' columns but content, with (line, kind, snippet): one row for each pattern that a line matches.

    ``cap``, where given, stops after the first that many findings of a file, as a report would. The snippet is
    the trimmed line, its first 220 characters; the whole line is searched.
    """
    others = [c for c in files.columns if c != "content"]
    lines = files.select(*others, F.posexplode(F.split("content", "\n")).alias("_i", "_raw"))
    t, raw = F.lower("_raw"), F.col("_raw")
    any_of = lambda c, words: c.rlike("|".join(re.escape(w) for w in words))
    rules: list[tuple[str, Column]] = [
        ("SPARQLInjectionCandidate", any_of(t, ["sparql", "select "]) & any_of(t, ["where", "query"])),
        ("DynamicQueryConstruction", any_of(t, ["select ", "where "]) & any_of(raw, ["format!(", " + ", "${"])),
        ("SecretExposureCandidate", any_of(t, ["token", "apikey", "api_key", "secret", "password"]) & any_of(t, ["let", "var", "const", ":", "="])),
        ("CommandExecutionSurface", any_of(t, ["popen(", "exec(", "system(", "std::process", "command::new"])),
        ("NetworkRequestSurface", any_of(t, ["urlopen", "requests.get", "http.get", "fetch(", "reqwest"])),
        ("MemorySafetyReviewSurface", any_of(t, ["unsafe", "transmute", "from_raw"])),
    ]
    kinds = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))
    hit = lines.select(*others, (F.col("_i") + 1).alias("line"), F.posexplode(kinds).alias("_k", "kind"), F.substring(F.trim("_raw"), 1, 220).alias("snippet"))
    if cap is not None:
        from pyspark.sql import Window

        w = Window.partitionBy("path").orderBy("line", "_k")
        hit = hit.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")
    hit = hit.drop("_k")
    manifests = files.where(F.col("path").rlike(r"(Cargo\.toml|package\.json)$"))
    manifests = manifests.select(*others, F.lit(1).alias("line"), F.lit("DependencyGraphSurface").alias("kind"), F.concat(F.lit("manifest: "), "path").alias("snippet"))
    return hit.unionByName(manifests)


def dependencies(path: str, content: str) -> tuple[str, list[tuple[str, str | None]]] | None:
    """(manager, [(name, version)]) of a manifest; None for other files and for what can't be read."""
    if path.endswith("Cargo.toml"):
        out, inside = [], False
        for line in content.splitlines():
            line = line.split("#")[0].strip()
            if line.startswith("["):
                inside = bool(re.fullmatch(r"\[(?:.*\.)?(?:dev-|build-)?dependencies\]", line))
            elif inside and "=" in line:
                name, _, value = line.partition("=")
                version = re.search(r'version\s*=\s*"([^"]+)"', value) or re.match(r'\s*"([^"]+)"', value)
                out.append((name.strip().strip('"'), version and version[1]))
        return "cargo", out
    if path.endswith("package.json"):
        try:
            got = json.loads(content)
        except ValueError:
            return None
        if not isinstance(got, dict):
            return None
        groups = [got.get(k) for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")]
        return "npm", [(n, str(v)) for g in groups if isinstance(g, dict) for n, v in g.items()]
    return None


def slug_text(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


def package_iri(manager: str, name: str, version: str | None) -> str:
    return f"urn:package:{manager}:{name}" + (f"@{version}" if version else "")


def file_facts(repo: str, path: str, content: str) -> list[tuple[str, str, str, str, str]]:
    out: list[tuple[str, str, str, str, str]] = []
    iri = lambda s, p, o: out.append((s, p, o, m.IRI, ""))
    text = lambda s, p, o: out.append((s, p, str(o), m.STRING, ""))
    f = f"{repo}/file/{path}"
    suffix = path[path.rfind(".") :] if "." in path else ""
    iri(repo, CODE + "containsFile", f)
    iri(f, m.TYPE, CODE + "SourceFile")
    text(f, CODE + "path", path)
    text(f, CODE + "language", LANGUAGES.get(suffix, "text"))
    text(f, CODE + "lineCount", len(content.splitlines()))
    if got := dependencies(path, content):
        manager, packages = got
        iri(f, m.TYPE, CODE + "PackageManifest")
        iri(repo, CODE + "hasManifest", f)
        for name, version in packages:
            package = package_iri(manager, name, version)
            iri(package, m.TYPE, CODE + "Package")
            text(package, CODE + "name", name)
            iri(f, CODE + "dependsOnPackage", package)
            iri(repo, CODE + "dependsOnPackage", package)

    def symbol(name: str, kind: str, exported: bool) -> str:
        x = f"{f}#{slug_text(name)}"
        iri(x, m.TYPE, CODE + kind)
        text(x, CODE + "name", name)
        iri(x, CODE + "definedIn", f)
        iri(f, CODE + "defines", x)
        if exported:
            iri(f, CODE + "exports", x)
        return x

    def module(name: str) -> None:
        x = f"{repo}/module/{slug_text(name)}"
        iri(x, m.TYPE, CODE + "Module")
        text(x, CODE + "name", name)
        iri(f, CODE + "imports", x)

    if suffix == ".rs":
        caller = None
        for line in content.splitlines():
            if used := re.match(r"\s*(?:pub\s+)?use\s+([A-Za-z_]\w*)", line):
                module(used[1])
            elif item := re.match(r"\s*(pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait)\s+([A-Za-z_]\w*)", line):
                x = symbol(item[3], _ITEM[item[2]], bool(item[1]))
                caller = x if item[2] == "fn" else caller
            elif caller:
                for call in re.findall(r"\b([A-Za-z_][\w:]*)\s*\(", line):
                    if call not in ("if", "while", "match", "for", "fn", "return"):
                        callee = f"{repo}/symbol/{slug_text(call)}"
                        iri(callee, m.TYPE, CODE + "Callable")
                        text(callee, CODE + "name", call)
                        iri(caller, CODE + "calls", callee)
    elif suffix in (".js", ".jsx", ".mjs", ".ts", ".tsx"):
        for line in content.splitlines():
            for used in re.findall(r"""(?:from|require\(|import)\s*['"]([^'"]+)['"]""", line):
                module(used)
            if item := re.match(r"\s*(export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?\s*([A-Za-z_$][\w$]*)|class\s+([A-Za-z_$][\w$]*)|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>)", line):
                symbol(item[2] or item[3] or item[4], "Class" if item[3] else "Function", bool(item[1]))
    for cve in dict.fromkeys(re.findall(r"CVE-\d{4}-\d{4,}", content)) if re.search(r"(?i)sbom|vuln|audit|advisor", path) else ():
        v = f"{SECURITY}vuln/{cve}"
        iri(v, m.TYPE, SECURITY + "Vulnerability")
        text(v, SECURITY + "cve", cve)
        for manager, name, version in re.findall(r"pkg:(\w+)/([\w./-]+)@([\w.-]+)", content):
            iri(package_iri(manager, name, version), SECURITY + "hasVulnerability", v)
    return out


def facts(files: DataFrame, repo: str) -> DataFrame:
    """Quads about a repository's files (path, content), each statement once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for path, content in zip(b["path"], b["content"]) if path is not None for r in file_facts(repo, path, content or "")]
            yield pd.DataFrame(rows, columns=["s", "p", "o", "o_dt", "o_lang"])

    found = files.select("path", "content").mapInPandas(run, _ROWS)
    head = files.sparkSession.createDataFrame([(repo, m.TYPE, CODE + "Repository", m.IRI, "")], _ROWS)
    return m.conform(found.unionByName(head).dropDuplicates())


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a folder's text files."""
    df = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    return df.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))

