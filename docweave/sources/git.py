"""Facts from git, asked on the driver; only small results become DataFrames."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


class Git:
    def __init__(self, root: str):
        self.root = root

    def run(self, *args: str) -> str | None:
        found = subprocess.run(["git", "-C", self.root, *args], capture_output=True, text=True, check=False)
        return found.stdout if found.returncode == 0 else None

    def available(self) -> bool:
        return self.run("rev-parse", "HEAD") is not None

    def shallow(self) -> bool:
        return (self.run("rev-parse", "--is-shallow-repository") or "").strip() == "true"

    def resolves(self, commit: str) -> bool:
        return self.run("cat-file", "-e", f"{commit}^{{commit}}") is not None

    def ancestor(self, commit: str) -> bool:
        return self.run("merge-base", "--is-ancestor", commit, "HEAD") is not None

    def changed(self, commit: str) -> list[str]:
        """Files that differ between a commit and the working tree."""
        return [x for x in (self.run("diff", "--name-only", "--relative", commit) or "").split("\n") if x]

    def facts(self, spark: SparkSession, commits: list[str]) -> tuple[DataFrame, DataFrame]:
        """(commit, resolves, ancestor) and (commit, path) of what changed since."""
        rows = [(c, self.resolves(c), self.ancestor(c)) for c in commits]
        diffs = [(c, p) for c, ok, _ in rows if ok for p in self.changed(c)]
        return spark.createDataFrame(rows, "commit string, resolves boolean, ancestor boolean"), spark.createDataFrame(diffs, "commit string, path string")

    def dirty(self, spark: SparkSession) -> DataFrame:
        rows = [(x[3:].split(" -> ")[-1].strip('"'),) for x in (self.run("status", "--porcelain") or "").split("\n") if x]
        return spark.createDataFrame(rows, "path string")

    def tags(self) -> list[str]:
        """Tags, the oldest first."""
        return [x for x in (self.run("for-each-ref", "--sort=creatordate", "--format=%(refname:short)", "refs/tags") or "").split("\n") if x]

    def tree(self, ref: str, suffix: str = ".md") -> list[tuple[str, str]]:
        """(path, content) of the files of a tree."""
        paths = [p for p in (self.run("ls-tree", "-r", "--name-only", ref) or "").split("\n") if p.endswith(suffix)]
        return [(p, self.run("show", f"{ref}:{p}") or "") for p in paths]

    def churn(self, spark: SparkSession) -> DataFrame:
        """(path, ts) of every file that a commit touched."""
        rows, ts = [], 0
        for x in (self.run("log", "--format=@%ct", "--name-only", "--relative") or "").split("\n"):
            if x.startswith("@") and x[1:].isdigit():
                ts = int(x[1:])
            elif x:
                rows.append((x, ts))
        return spark.createDataFrame(rows, "path string, ts long")
