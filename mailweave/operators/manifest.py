"""Numbered manifests: small JSON files that say which folders of a store count.

A manifest appears whole, by renaming a draft; readers take the last one.  Folders that a change has replaced are kept until the next
change, for readers that have begun.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    target, fs = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


class Manifest:
    """The manifests below ``root``: ``version``, ``retired`` folders, and what a store adds.  There is one writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def read(self) -> dict:
        versions = [n for n in names_in(self.spark, os.path.join(self.root, "manifest")) if n.endswith(".json")]
        if not versions:
            return {"version": 0, "retired": []}
        place, fs = file_system(self.spark, os.path.join(self.root, "manifest", versions[-1]))
        file = fs.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def commit(self, now: dict, after: dict, retired: list[str]) -> None:
        """Replace ``now`` by ``after``; ``retired`` folders, below the root, go with the change after this one."""
        version = now["version"] + 1
        place, fs = file_system(self.spark, os.path.join(self.root, "manifest", f"{version:012d}.json"))
        draft, _ = file_system(self.spark, os.path.join(self.root, "drafts", uuid.uuid4().hex))
        out = fs.create(draft, True)
        out.write(json.dumps({**after, "version": version, "retired": retired}).encode())
        out.close()
        fs.mkdirs(place.getParent())
        if fs.exists(place) or not fs.rename(draft, place):
            raise RuntimeError(f"another writer has made version {version} of {self.root}")
        for folder in now["retired"]:
            self.remove(folder)

    def remove(self, folder: str) -> None:
        target, fs = file_system(self.spark, os.path.join(self.root, folder))
        fs.delete(target, True)
