"""A Parquet folder that is appended to, with settled generations beside the appended files.

Appended files lie in the folder itself. A settled generation lies below ``_settled``, which plain
readers of the folder skip, and a manifest there names it together with the appended files whose rows
it has taken over. The highest manifest counts. A manifest appears by one rename after its generation
is complete, so a run that is lost half-way changes nothing; nothing is removed before ``vacuum``.
"""

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SETTLED = "_settled"
MANIFEST = "manifest-"


@dataclass(frozen=True)
class State:
    """What a reader sees at one moment."""

    number: int = 0
    generation: str | None = None
    buckets: int = 0
    covered: frozenset = frozenset()
    fresh: list[str] = field(default_factory=list)


class Generations:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _fs(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _names(self, *parts: str) -> list[str]:
        fs, folder = self._fs(), self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def _manifests(self) -> dict[int, str]:
        return {int(n.removeprefix(MANIFEST)): n for n in self._names(SETTLED) if n.startswith(MANIFEST)}

    def _content(self, name: str) -> dict:
        stream = self._fs().open(self._path(SETTLED, name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def state(self) -> State:
        """The manifest is read after the files are listed: rows that a compaction takes over meanwhile are seen
        in both places, never in none."""
        files = [n for n in self._names() if not n.startswith(("_", "."))]
        manifests = self._manifests()
        if not manifests:
            return State(fresh=files)
        number = max(manifests)
        told = self._content(manifests[number])
        covered = frozenset(told["covered"])
        return State(number, told["generation"], told["buckets"], covered, [n for n in files if n not in covered])

    def fresh(self, state: State, schema: str) -> DataFrame:
        """The appended rows that no generation holds."""
        paths = [f"{self.path}/{n}" for n in state.fresh]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def settled(self, state: State, schema: str) -> DataFrame:
        """The rows of the generation with their ``bucket``."""
        schema = f"{schema}, bucket int"
        if state.generation is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{SETTLED}/{state.generation}")

    def new_generation(self) -> str:
        return f"generation-{uuid.uuid4().hex}"

    def folder(self, generation: str) -> str:
        return f"{self.path}/{SETTLED}/{generation}"

    def publish(self, seen: State, generation: str, buckets: int) -> bool:
        """Makes a written generation the current one; False if another one came first."""
        fs, number = self._fs(), seen.number + 1
        content = {"generation": generation, "buckets": buckets, "covered": sorted({*seen.covered, *seen.fresh})}
        pending, final = self._path(SETTLED, f".{uuid.uuid4().hex}"), self._path(SETTLED, f"{MANIFEST}{number:012d}")
        stream = fs.create(pending, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        if not fs.exists(final) and fs.rename(pending, final):
            return True
        fs.delete(pending, False)
        return False

    def vacuum(self) -> int:
        """Removes what the current manifest has replaced, and says how many files and folders that were.

        For times when no earlier reader and no compaction is at work.
        """
        state, fs = self.state(), self._fs()
        if state.generation is None:
            return 0
        old = [self._path(n) for n in self._names() if n in state.covered]
        current = {state.generation, f"{MANIFEST}{state.number:012d}"}
        old += [self._path(SETTLED, n) for n in self._names(SETTLED) if n not in current]
        return sum(bool(fs.delete(p, True)) for p in old)
