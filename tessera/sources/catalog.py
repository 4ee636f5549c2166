"""Collections and their vector spaces: one small JSON file for each collection.

The files lie beside the tables in any folder that Spark's Hadoop file systems reach, so the
catalog is read and written through them. There is one writer of a collection at a time.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import SparkSession

NAME = re.compile(r"[A-Za-z0-9-]+")
STATUSES = ("active", "building", "deprecated")


class CollectionError(ValueError):
    pass


class NotFound(CollectionError):
    pass


def check_name(name: str) -> str:
    if not isinstance(name, str) or not NAME.fullmatch(name):
        raise CollectionError(f"a name has letters, digits and hyphens only, not {name!r}")
    return name


@dataclass
class VectorSpace:
    dims: int
    model: str = "bge-small-en-v1.5"
    status: str = "active"
    version: int = 0  # of the folder that holds its vectors
    live: list[int] = field(default_factory=list)  # the batches that have vectors of it
    index: dict | None = None  # of its inverted file: where it lies and what it was built with

    def __post_init__(self) -> None:
        if not isinstance(self.dims, int) or self.dims < 1:
            raise CollectionError("a vector space has a dimension or more")
        if self.status not in STATUSES:
            raise CollectionError(f"status is one of {STATUSES}")


@dataclass
class Collection:
    name: str
    created_at: str
    vector_spaces: dict[str, VectorSpace]
    default_vector_space: str | None
    embedding_dims: int
    chunk_count: int = 0
    next_id: int = 0
    total_terms: int = 0
    batches: int = 0  # the next batch's number
    live: list[int] = field(default_factory=list)  # the batches that are read
    streams: dict[str, int] = field(default_factory=dict)  # of each stream the last micro-batch that was ingested
    config: dict = field(default_factory=lambda: {"embed_model": "bge-small"})
    rebuilds: dict[str, dict] = field(default_factory=dict)

    @staticmethod
    def load(text: str) -> Collection:
        raw = json.loads(text)
        every = list(range(raw.get("batches", 0)))  # what files of an earlier form mean
        raw["vector_spaces"] = {k: VectorSpace(**{"live": every, **v}) for k, v in raw["vector_spaces"].items()}
        raw.setdefault("live", every)
        return Collection(**raw)


class Files:
    """Whole small files and folders through Hadoop."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def read(self, path: str) -> str | None:
        files, p = self._at(path)
        if not files.exists(p):
            return None
        stream = files.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """The old content or the new, never a part: written aside, then renamed over it."""
        files, p = self._at(path)
        _, aside = self._at(f"{path}.new")
        stream = files.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if files.exists(p):
            files.delete(p, False)
        if not files.rename(aside, p):
            raise OSError(f"{path} can't be written")

    def exists(self, path: str) -> bool:
        files, p = self._at(path)
        return files.exists(p)

    def is_folder(self, path: str) -> bool:
        files, p = self._at(path)
        return files.exists(p) and files.getFileStatus(p).isDirectory()

    def delete(self, path: str) -> bool:
        files, p = self._at(path)
        return files.delete(p, True)

    def folders(self, path: str) -> list[str]:
        files, p = self._at(path)
        return sorted(s.getPath().getName() for s in files.listStatus(p) if s.isDirectory()) if files.exists(p) else []


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.files, self.root = Files(spark), root.rstrip("/")

    def folder(self, name: str) -> str:
        return f"{self.root}/{check_name(name)}"

    def _file(self, name: str) -> str:
        return f"{self.folder(name)}/collection.json"

    def names(self) -> list[str]:
        return [n for n in self.files.folders(self.root) if NAME.fullmatch(n) and self.files.exists(self._file(n))]

    def list(self) -> list[Collection]:
        return [c for n in self.names() if (c := self.get(n))]

    def get(self, name: str) -> Collection | None:
        text = (self.files.read(self._file(name)) or self.files.read(f"{self._file(name)}.new")) if NAME.fullmatch(name or "") else None
        return Collection.load(text) if text else None

    def need(self, name: str) -> Collection:
        if not (c := self.get(name)):
            raise NotFound(f"there is no collection {name!r}")
        return c

    def save(self, collection: Collection) -> None:
        self.files.write(self._file(collection.name), json.dumps(asdict(collection), indent=2))

    def create(self, name: str, vector_spaces: dict[str, VectorSpace] | None = None, embedding_dims: int | None = None, config: dict | None = None) -> Collection:
        """Without spaces there is one, `default`; the first of several is the default one."""
        if self.get(check_name(name)):
            raise CollectionError(f"there is a collection {name!r}")
        dims = embedding_dims or 384
        spaces = dict(vector_spaces or {"default": VectorSpace(dims)})
        for s in spaces:
            check_name(s)
        c = Collection(name, datetime.now(UTC).isoformat(), spaces, next(iter(spaces)), dims)
        c.config |= config or {}
        self.save(c)
        return c

    def delete(self, name: str) -> None:
        self.need(name)
        self.files.delete(self.folder(name))

    def add_space(self, name: str, space: str, dims: int, model: str) -> VectorSpace:
        c = self.need(name)
        if check_name(space) in c.vector_spaces:
            raise CollectionError(f"{name!r} has a vector space {space!r}")
        c.vector_spaces[space] = VectorSpace(dims, model, "building")
        c.default_vector_space = c.default_vector_space or space
        self.save(c)
        return c.vector_spaces[space]

    def delete_space(self, name: str, space: str) -> None:
        """An unknown space is no error; the default one can't go."""
        c = self.need(name)
        if check_name(space) == c.default_vector_space:
            raise CollectionError("the default vector space can't be deleted")
        if c.vector_spaces.pop(space, None):
            self.save(c)
            self.files.delete(f"{self.folder(name)}/vectors/{space}")

    def set_default_space(self, name: str, space: str) -> None:
        c = self.need(name)
        if space not in c.vector_spaces:
            raise NotFound(f"{name!r} has no vector space {space!r}")
        c.default_vector_space = space
        self.save(c)

    def set_status(self, name: str, space: str, status: str) -> None:
        c = self.need(name)
        if space not in c.vector_spaces:
            raise NotFound(f"{name!r} has no vector space {space!r}")
        c.vector_spaces[space].status = VectorSpace(1, status=status).status
        self.save(c)
