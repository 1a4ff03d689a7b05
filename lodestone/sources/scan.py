"""File trees as tables: root discovery, a walk with ignore rules, and a data source that also reads hidden names.

Spark's own binary reader leaves out names that begin with a dot or an underscore, so files are listed by a walk and
read by executors. On a cluster the tree must be mounted on all of them."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.sources.ignore import IgnoreTree

IGNORE_FILE = ".gitignore"
#: Directories at the root that are never walked: version control, and our own stored index.
PRUNED = {".git", ".lodestone"}
LISTING = "path string, size_bytes long, last_modified_ns long"
SCAN = LISTING + ", content binary"


def find_root(path: str | os.PathLike) -> Path | None:
    """The nearest directory upward that has a `.git` directory; a `.git` file (a submodule) doesn't count."""
    start = Path(path).absolute()
    for p in (start, *start.parents):
        if p.is_dir() and (p / ".git").is_dir() and (p != Path(p.anchor) or p == start):
            return p
    return None


def walk(root: str | os.PathLike) -> Iterator[tuple[str, int, int]]:
    """(relative path, size, time in ns) of each file that isn't ignored. Links and hidden directories are left out, hidden files kept."""
    tree, stack = IgnoreTree(), [""]
    while stack:
        directory = stack.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, directory)), key=lambda e: e.name)
        except (PermissionError, FileNotFoundError, NotADirectoryError):
            continue
        rules = next((e for e in entries if e.name == IGNORE_FILE and e.is_file(follow_symlinks=False)), None)
        if rules:
            tree.add(directory, Path(rules.path).read_text(encoding="utf-8", errors="replace"))
        for e in entries:
            path = f"{directory}/{e.name}" if directory else e.name
            if e.is_symlink() or not directory and e.name in PRUNED:
                continue
            is_dir = e.is_dir(follow_symlinks=False)
            if tree.ignored(path, is_dir):
                continue
            if is_dir:
                if not e.name.startswith("."):
                    stack.append(path)
            elif e.is_file(follow_symlinks=False):
                try:
                    s = e.stat(follow_symlinks=False)
                except FileNotFoundError:
                    continue
                yield path, s.st_size, s.st_mtime_ns


def look(root: str | os.PathLike, paths: Iterable[str]) -> list[tuple[str, int, int]]:
    """What walk() would yield of some relative paths: only they and the rules of the directories above them are read."""
    tree, known, out = IgnoreTree(), set(), []
    for path in sorted(set(paths)):
        parts = path.split("/")
        above = ["/".join(parts[:i]) for i in range(len(parts))]
        if any(x in ("", ".", "..") for x in parts) or parts[0] in PRUNED or any(x.startswith(".") for x in parts[:-1]):
            continue
        if any(os.path.islink(os.path.join(root, *parts[:i])) for i in range(1, len(parts) + 1)):
            continue
        for directory in above:
            if directory not in known:
                known.add(directory)
                rules = Path(root, directory, IGNORE_FILE)
                if rules.is_file() and not rules.is_symlink():
                    tree.add(directory, rules.read_text(encoding="utf-8", errors="replace"))
        try:
            s = os.stat(os.path.join(root, path), follow_symlinks=False)
        except (FileNotFoundError, NotADirectoryError, PermissionError):
            continue
        if stat.S_ISREG(s.st_mode) and not tree.hides(path):
            out.append((path, s.st_size, s.st_mtime_ns))
    return out


class TreeReader(DataSourceReader):
    """Lists on the driver, reads on the executors, `files` of them a partition."""

    def __init__(self, options):
        self.root, self.files, self.content = options["path"], int(options.get("filesPerPartition", 256)), options.get("content", "true") == "true"

    def partitions(self):
        found = list(walk(self.root))
        return [InputPartition(found[i : i + self.files]) for i in range(0, len(found), self.files)] or [InputPartition([])]

    def read(self, partition):
        for path, size, time in partition.value:
            if not self.content:
                yield path, size, time
                continue
            try:
                yield path, size, time, Path(self.root, path).read_bytes()
            except (FileNotFoundError, PermissionError):
                continue  # gone meanwhile: the next snapshot says so


class TreeSource(DataSource):
    """`spark.read.format("filetree").load(root)`; option content=false lists only."""

    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return SCAN if self.options.get("content", "true") == "true" else LISTING

    def reader(self, schema):
        return TreeReader(self.options)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("filetree").option("content", "false").load(str(root))


def read_contents(listed: DataFrame, root: str) -> DataFrame:
    """The listed files with their bytes; files that are gone drop out."""
    base = str(root)

    def run(parts):
        for pdf in parts:
            kept = []
            for p in pdf["path"]:
                try:
                    kept.append(Path(base, p).read_bytes())
                except (FileNotFoundError, PermissionError):
                    kept.append(None)
            pdf = pdf.assign(content=kept)
            yield pdf[pdf["content"].notna()]

    return listed.select("path", "size_bytes", "last_modified_ns").mapInPandas(run, SCAN)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, last_modified_ns, content) of every file of the tree."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("filetree").load(str(root))


def text_files(scanned: DataFrame) -> DataFrame:
    """Without binary files (those with a zero byte)."""
    return scanned.where(~F.contains("content", F.lit(bytes([0]))))
