"""A durable store: a folder of tables and numbered manifests.

A manifest names the base quads and the deltas over them, the graphs and the
ontology. Tables are written first and never changed; a version exists once its
manifest does, and only one writer can create a given one. So a reader always
sees a whole snapshot, and a commit writes as much as the change.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyspark.sql import SparkSession

from .dataset import QUAD_SQL, Dataset, Delta
from .errors import Conflict, NoSpace, OntologyMissing, OpenFailed
from .ontology import Ontology


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        try:
            self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        except Exception as e:
            raise OpenFailed(f"{root}: {e}") from None
        self.version = 0

    def versions(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.root}/manifest-*.json")) or []
        return sorted(int(str(f.getPath().getName())[9:-5]) for f in found)

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest-{version:010d}.json"

    def open(self, ontology: Ontology | None = None, version: int | None = None) -> Dataset:
        """The newest snapshot, or the one of a version; a new store starts empty."""
        have = self.versions()
        if not have:
            if ontology is None:
                raise OntologyMissing(f"{self.root} is a new store")
            return Dataset(self.spark, ontology, root=self.root)
        self.version = version or have[-1]
        if self.version not in have:
            raise OpenFailed(f"{self.root} has no version {self.version}")
        d = json.loads(self.spark.read.text(self._manifest(self.version), wholetext=True).first()[0])
        read = lambda path, schema: self.spark.read.schema(schema).parquet(f"{self.root}/{path}")
        data = Dataset(self.spark, Ontology.from_json(d["ontology"]), graphs=frozenset(d["graphs"]), root=self.root)
        if d["base"]:
            data = data.with_quads(read(d["base"], QUAD_SQL), f"{self.root}/{d['base']}")
        deltas = tuple(Delta(read(t, "s string"), read(q, QUAD_SQL), (f"{self.root}/{t}", f"{self.root}/{q}")) for t, q in d["deltas"])
        return data.assembled(deltas) if deltas else data

    def commit(self, data: Dataset) -> Dataset:
        """Publishes a snapshot as the next version; what is not in the folder yet is written."""
        if data.tables:
            data = data.flattened()
        if data.base is not None and not (data.base_path or "").startswith(self.root):
            deltas = data.deltas
            base, path = replace(data, root=self.root).write(data.base, "quads")
            data = replace(data.with_quads(base, path), root=self.root)
            data = data.assembled(deltas) if deltas else data
        short = lambda p: p[len(self.root) + 1 :]
        told = {"base": short(data.base_path) if data.base is not None else None, "deltas": [[short(p) for p in d.paths] for d in data.deltas], "graphs": sorted(data.graphs), "ontology": data.ontology.to_json()}
        draft = self._path(f"{self.root}/draft-{uuid.uuid4().hex}")
        try:
            out = self._fs.create(draft)
            out.write(json.dumps(told).encode())
            out.close()
            self._fs.mkdirs(self._path(self.root))
            final = self._path(self._manifest(self.version + 1))
            if self._fs.exists(final) or not self._fs.rename(draft, final):
                self._fs.delete(draft, False)
                raise Conflict(f"version {self.version + 1} of {self.root} exists")
        except Conflict:
            raise
        except Exception as e:
            kind = NoSpace if "No space left" in str(e) or "quota" in str(e).lower() else OpenFailed
            raise kind(f"{self.root}: {e}") from None
        self.version += 1
        return data

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all but the newest manifests, and the tables that none of the rest names."""
        have = self.versions()
        used: set[str] = set()
        for v in have[-keep:]:
            d = json.loads(self.spark.read.text(self._manifest(v), wholetext=True).first()[0])
            used |= {d["base"], *(p for pair in d["deltas"] for p in pair)} - {None}
        for v in have[:-keep]:
            self._fs.delete(self._path(self._manifest(v)), False)
        for f in self._fs.globStatus(self._path(f"{self.root}/tables/*")) or []:
            if f"tables/{f.getPath().getName()}" not in used:
                self._fs.delete(f.getPath(), True)
