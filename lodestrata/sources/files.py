"""Source files as rows: listing with pruned directories and ignore files, languages, text, hashes.

Directories are listed through Hadoop's file systems, pruned ones never entered; only names come to the driver.
Contents are read on the executors: by Spark's file source, which passes over names that start with _ or ., and
those by pyarrow.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import accumulate, groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that are pruned from every listing, and those that fast mode prunes besides.
SKIPPED_DIRS = (
    ".git", ".hg", ".svn", ".worktrees", ".idea", ".vs", ".vscode", ".eclipse", ".claude", ".cache", ".eggs", ".env", ".mypy_cache", ".nox",
    ".pytest_cache", ".ruff_cache", ".tox", ".venv", "__pycache__", "env", "htmlcov", "site-packages", "venv", ".npm", ".nyc_output", ".pnpm-store",
    ".yarn", "bower_components", "coverage", "node_modules", ".next", ".nuxt", ".svelte-kit", ".angular", ".turbo", ".parcel-cache", ".docusaurus",
    ".expo", "dist", "obj", "Pods", "target", "temp", "tmp", ".terraform", ".serverless", "bazel-bin", "bazel-out", "bazel-testlogs", ".cargo",
    ".stack-work", ".dart_tool", "zig-cache", "zig-out", ".metals", ".bloop", ".bsp", ".ccls-cache", ".clangd", "elm-stuff", "_opam", ".cpcache",
    ".shadow-cljs", ".vercel", ".netlify", ".qdrant_code_embeddings", ".tmp", "vendor",
)
FAST_DIRS = (
    "generated", "gen", "auto-generated", "fixtures", "testdata", "test_data", "__tests__", "__mocks__", "__snapshots__", "__fixtures__", "__test__",
    "docs", "doc", "documentation", "examples", "example", "samples", "sample", "assets", "static", "public", "media", "third_party", "thirdparty",
    "3rdparty", "external", "migrations", "seeds", "e2e", "integration", "locale", "locales", "i18n", "l10n", "scripts", "tools", "hack", "bin",
    "build", "out",
)
SKIPPED_ENDINGS = (
    ".tmp", "~", ".pyc", ".pyo", ".o", ".a", ".so", ".dll", ".class", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".bmp", ".tiff", ".webp", ".svg",
    ".wasm", ".node", ".exe", ".bin", ".dat", ".db", ".sqlite", ".sqlite3", ".woff", ".woff2", ".ttf", ".eot", ".otf",
)
FAST_ENDINGS = (
    ".zip", ".tar", ".gz", ".bz2", ".xz", ".rar", ".7z", ".jar", ".war", ".ear", ".mp3", ".mp4", ".avi", ".mov", ".wav", ".flac", ".ogg", ".mkv",
    ".webm", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".ods", ".map", ".min.js", ".min.css", ".pem", ".crt", ".key", ".cer",
    ".p12", ".pb", ".avro", ".parquet", ".beam", ".elc", ".rlib", ".coverage", ".prof", ".out", ".patch", ".diff",
)
FAST_NAMES = (
    "LICENSE", "LICENSE.txt", "LICENSE.md", "LICENSE-MIT", "LICENSE-APACHE", "LICENCE", "LICENCE.txt", "LICENCE.md", "CHANGELOG", "CHANGELOG.md",
    "CHANGES.md", "HISTORY", "HISTORY.md", "AUTHORS", "AUTHORS.md", "CONTRIBUTORS", "CONTRIBUTORS.md", "CODEOWNERS", "go.sum", "yarn.lock",
    "pnpm-lock.yaml", "Pipfile.lock", "poetry.lock", "Gemfile.lock", "Cargo.lock", "mix.lock", "flake.lock", "pubspec.lock", "composer.lock",
    "package-lock.json", "configure", "Makefile.in", "config.guess", "config.sub",
)
FAST_PARTS = (
    ".d.ts", ".bundle.", ".chunk.", ".generated.", ".pb.go", "_pb2.py", ".pb2.py", "_grpc.pb.go", "_string.go", "mock_", "_mock.", "_test_helpers.",
    ".stories.", ".spec.", ".test.",
)
LANGUAGES = {"py": "Python", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "tsx": "Tsx"}


def language(path: Column) -> Column:
    """By the ending; null for files that are not indexed."""
    ending = F.regexp_extract(path, r"\.([^./]+)$", 1)
    return reduce(lambda c, kv: c.when(ending == kv[0], kv[1]), LANGUAGES.items(), F.when(F.lit(False), F.lit(None).cast("string")))


def _any(words: tuple[str, ...]) -> str:
    return "|".join(map(re.escape, words))


def pruned(rel_path: Column, fast: bool = False) -> Column:
    """Whether a directory on the way, or the file's name, is left out."""
    dirs = SKIPPED_DIRS + FAST_DIRS * fast
    out = rel_path.rlike(f"(^|/)({_any(dirs)})/") | rel_path.rlike(f"({_any(SKIPPED_ENDINGS + FAST_ENDINGS * fast)})$")
    if fast:
        out = out | rel_path.rlike(f"(^|/)({_any(FAST_NAMES)})$") | rel_path.rlike(f"(^|/)[^/]*({_any(FAST_PARTS)})[^/]*$")
    return out


def ignore_regex(pattern: str, base: str = "") -> tuple[str, bool] | None:
    """(regex over relative paths, whether it brings files back) of a line of an ignore file in directory base."""
    line = pattern.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    back, line = line.startswith("!"), line.lstrip("!")
    only_dirs, body = line.endswith("/"), line.strip("/")
    rooted = line.startswith("/") or "/" in body
    said = "".join(
        {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, t if t.startswith("[") else re.escape(t))
        for t in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]+\]|[^*?\[/]+|/|\[", body)
    )
    start = re.escape(base.strip("/") + "/") if base.strip("/") else ""
    return f"^{start}{'' if rooted else '(?:.*/)?'}{said}{'/.*' if only_dirs else '(?:/.*)?'}$", back


def ignored(rel_path: Column, rules: list[tuple[str, bool]]) -> Column:
    """By the last rule that fits: rules in a row that mean the same are one pattern, and the runs one flat array."""
    runs = [(back, [r for r, _ in run]) for back, run in groupby(rules, key=lambda x: x[1])]
    if not runs:
        return F.lit(False)
    each = [F.when(rel_path.rlike("|".join(f"(?:{r})" for r in regexes)), F.lit(k)) for k, (_, regexes) in enumerate(runs)]
    last = F.coalesce(F.array_max(F.array(*each)), F.lit(-1))
    return F.element_at(F.array(F.lit(False), *[F.lit(not back) for back, _ in runs]), last + 2)


def listed(spark: SparkSession, root: str, fast: bool = False) -> tuple[list[tuple[str, str, int, int]], list[str]]:
    """(path, rel_path, mtime_s, size) of all files outside pruned directories, and the paths of ignore files."""
    skip = set(SKIPPED_DIRS) | set(FAST_DIRS if fast else ())
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    files, ignores, waiting = [], [], [(top, "")]
    while waiting:
        folder, at = waiting.pop()
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if status.isDirectory():
                if name not in skip:
                    waiting.append((status.getPath(), f"{at}{name}/"))
            elif name == ".gitignore":
                ignores.append((at, status.getPath()))
            else:
                files.append((status.getPath().toString(), at + name, status.getModificationTime() // 1000, status.getLen()))
    told = [(at, _text(spark, fs, path)) for at, path in sorted(ignores, key=lambda x: (x[0].count("/"), x[0]))]
    return sorted(files, key=lambda f: f[1]), [rule for at, text in told for line in text.splitlines() if (rule := ignore_regex(line, at))]


def _text(spark: SparkSession, fs, path) -> str:
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def _hidden_contents(batches):
    import pyarrow.fs

    for rows in batches:
        texts = []
        for path in rows["path"]:
            system, at = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
            with system.open_input_stream(at) as stream:
                texts.append(stream.read().decode("utf-8", "replace"))
        yield rows[["path"]].assign(content=texts)


def contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content) of the files."""
    hidden = [p for p in paths if p.rpartition("/")[2][:1] in ("_", ".")]
    plain = sorted(set(paths) - set(hidden))
    schema = "path string, content string"
    escaped = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in plain]
    read = spark.read.format("binaryFile").load(escaped).select("path", F.decode("content", "UTF-8").alias("content")) if plain else spark.createDataFrame([], schema)
    if not hidden:
        return read
    rows = spark.createDataFrame([(p,) for p in hidden], "path string").repartition(max(1, min(len(hidden) // 64, 1000)))
    return read.unionByName(rows.mapInPandas(_hidden_contents, schema))


def project_of(root: str) -> str:
    return root.rstrip("/").rpartition("/")[2]


def discover(spark: SparkSession, root: str, mode: str = "full", gitignore: bool = True, content: bool = True) -> DataFrame:
    """Indexed files below root: project, path, rel_path, language, content, mtime_s, size.

    mode fast prunes generated, vendored and documentation files besides. content=False reads no file.
    """
    found, rules = listed(spark, root, mode == "fast")
    files = spark.createDataFrame(found, "path string, rel_path string, mtime_s long, size long")
    files = files.withColumn("language", language(F.col("rel_path"))).withColumn("project", F.lit(project_of(root)))
    files = files.filter(F.col("language").isNotNull() & ~pruned(F.col("rel_path"), mode == "fast") & ~ignored(F.col("rel_path"), rules if gitignore else []))
    if not content:
        return files.select("project", "path", "rel_path", "language", "mtime_s", "size")
    texts = contents(spark, [r[0] for r in files.select("path").collect()])
    return files.join(texts.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")), "path", "left").select("project", "path", "rel_path", "language", "content", "mtime_s", "size")


def file_hashes(files: DataFrame) -> DataFrame:
    return files.select("project", "rel_path", "mtime_s", "size")


def documents_at(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """path and whole text of files of any of the text operators."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.decode("content", "UTF-8").alias(column))


def commits(log: DataFrame, line: str = "value", order: str = "ord") -> DataFrame:
    """(commit_ord, path) from lines of `git log --name-only --pretty=format:COMMIT`, with an order column.

    Whole logs are numbered in one partition, which only suits the log of one repository; where lines come with their
    commit's number, as from git_log, none of this is needed.
    """
    from pyspark.sql import Window

    marked = log.withColumn("commit_ord", F.sum((F.col(line) == "COMMIT").cast("long")).over(Window.orderBy(order)))
    return marked.filter((F.col(line) != "COMMIT") & (F.trim(line) != "")).select("commit_ord", F.trim(line).alias("path"))


def git_log(spark: SparkSession, repo: str, since: str = "1 year ago", most: int = 10_000) -> DataFrame:
    """(commit_ord, path) of a local repository's history; no rows where git fails."""
    import subprocess

    done = subprocess.run(["git", "-C", repo, "log", "--name-only", "--pretty=format:COMMIT", f"--since={since}", "-n", str(most)], capture_output=True, text=True, check=False)
    numbered = accumulate((done.stdout if done.returncode == 0 else "").splitlines(), lambda x, said: (x[0] + (said == "COMMIT"), said), initial=(0, ""))
    rows = [(n, said.strip()) for n, said in numbered if said.strip() and said != "COMMIT"]
    return spark.createDataFrame(rows, "commit_ord long, path string")
