"""Sharding with size-tiered compaction.

Arrivals are appended as runs: immutable folders of small Parquet shards. Runs of similar size (the same power of
``fan_in`` above the smallest tier) are merged, ``fan_in`` or more at a time, into one run of files near the target
size; merging continues until no tier holds enough runs. Every change is a new manifest version that lists the live
runs; it is written beside its place and renamed into it without overwriting, so a version is there whole or not at
all, a reader sees one version throughout, and of two writers of one version one fails and may try again. A run's
folder counts only through a manifest, so what a failed or repeated task leaves is never read. Folders that no
manifest of the last ``keep`` versions names are deleted by ``vacuum``, which only runs when it is called.

Merging reads shards in Spark partitions of a scan and narrows them to the wanted number of files; no row is
shuffled. The driver holds one manifest entry per live run, never file lists of rows.

Defined cases: nulls anywhere, repeated rows and any further columns are stored as they are, also if arrivals differ
in columns (then null where an arrival has none); texts of any length are one value of a shard; runs whose sizes are
equal are in one tier, and are merged in the order of their arrivals; an empty arrival makes no run; an empty table
has a manifest without runs and gives no rows. A column named _shard_run, _shard_tier or _shard_file is kept in the
shards, and replaced by this module's in what ``read`` returns.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinlode.llm.common import folder, free_names, shared_dir, table

FAN_IN = 4
TARGET_BYTES = 128 << 20
SMALLEST_TIER = 1 << 20
ARRIVALS = 8


@dataclass(frozen=True)
class Run:
    """A live run: folder name, bytes on disk, files, tier and the arrivals it holds."""

    name: str
    bytes: int
    files: int
    tier: int
    arrivals: tuple[str, ...]


class ConflictError(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, fan_in: int = FAN_IN, target_bytes: int = TARGET_BYTES, smallest_tier: int = SMALLEST_TIER):
        self.spark, self.root, self.fan_in = spark, root.rstrip("/"), fan_in
        self.target, self.smallest = target_bytes, smallest_tier

    def versions(self) -> list[int]:
        fs, p = folder(self.spark, f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Run]]:
        """The latest, or the given, version number and its runs; version 0 is empty."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return 0, []
        fs, p = folder(self.spark, f"{self.root}/manifest/v{version:09d}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, [Run(**r | {"arrivals": tuple(r["arrivals"])}) for r in json.loads(text)["runs"]]

    def commit(self, version: int, runs: list[Run]) -> int:
        """Make ``runs`` the manifest of ``version``; fails if that version is there."""
        jvm, name = self.spark._jvm, f"{self.root}/manifest/v{version:09d}.json"
        fs, final = folder(self.spark, name)
        _, draft = folder(self.spark, f"{self.root}/manifest/.draft-{uuid.uuid4().hex}")
        fs.mkdirs(draft.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "runs": [asdict(r) for r in runs]}, sort_keys=True).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            if fs.exists(final):
                raise ConflictError(name)
            no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            context.rename(context.makeQualified(draft), context.makeQualified(final), no_overwrite)
        except ConflictError:
            fs.delete(draft, False)
            raise
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise ConflictError(name) from e
            raise
        return version

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest, self.fan_in)) + 1) if size >= self.smallest else 0

    def _measured(self, name: str, arrivals: tuple[str, ...]) -> Run | None:
        fs, p = folder(self.spark, f"{self.root}/runs/{name}")
        sizes = [s.getLen() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")] if fs.exists(p) else []
        return Run(name, sum(sizes), len(sizes), self.tier(sum(sizes)), arrivals) if sizes else None

    def append(self, rows: DataFrame, arrival: str) -> int:
        """One arrival as one run."""
        by = free_names(rows, "arrival")[0]
        return self.append_all(rows.withColumn(by, F.lit(arrival)), by)

    def append_all(self, rows: DataFrame, by: str) -> int:
        """Every value of column ``by`` is an arrival and becomes a run; one pass over ``rows``, one version."""
        load = f"load-{uuid.uuid4().hex}"
        rows.withColumn("_shard_load", F.coalesce(F.col(by).cast("string"), F.lit("none"))).drop(by).write.partitionBy("_shard_load").parquet(f"{self.root}/runs/{load}")
        fs, p = folder(self.spark, f"{self.root}/runs/{load}")
        made = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
        runs = [self._measured(f"{load}/{d}", (d.split("=", 1)[1],)) for d in made]
        version, live = self.manifest()
        return self.commit(version + 1, live + [r for r in runs if r])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version with _shard_run and _shard_file; None without runs."""
        runs = self.manifest(version)[1]
        out = None
        for r in runs:
            part = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/runs/{r.name}")
            path = F.input_file_name()  # not _metadata, which may be a column of the rows
            part = part.drop("_shard_run", "_shard_tier", "_shard_file").withColumns({"_shard_run": F.lit("+".join(r.arrivals)), "_shard_tier": F.lit(r.tier), "_shard_file": F.regexp_extract(path, r"part-(\d+)", 1).cast("int")})
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def compact(self) -> int:
        """Merge until no tier holds ``fan_in`` runs; returns the version reached."""
        while True:
            version, live = self.manifest()
            tiers: dict[int, list[Run]] = {}
            for r in live:
                tiers.setdefault(r.tier, []).append(r)
            full = {t: rs for t, rs in tiers.items() if len(rs) >= self.fan_in}
            if not full:
                return version
            tier = min(full)
            old = sorted(full[tier], key=lambda r: r.arrivals)
            merged = self._merge(old)
            try:
                self.commit(version + 1, [r for r in live if r not in old] + ([merged] if merged else []))
            except ConflictError:
                continue  # another writer came first: plan anew on its version

    def _merge(self, old: list[Run]) -> Run | None:
        name = f"merge-{uuid.uuid4().hex}"
        files = max(1, round(sum(r.bytes for r in old) / self.target))
        rows = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/runs/{r.name}" for r in old])
        rows.coalesce(files).write.parquet(f"{self.root}/runs/{name}")
        return self._measured(name, tuple(sorted(a for r in old for a in r.arrivals)))

    def vacuum(self, keep: int = 1) -> None:
        """Delete run folders that only manifests older than the last ``keep`` name."""
        known = self.versions()
        used = {r.name for v in known[-keep:] for r in self.manifest(v)[1]}
        for v in known[:-keep]:
            for r in self.manifest(v)[1]:
                if r.name not in used:
                    fs, p = folder(self.spark, f"{self.root}/runs/{r.name}")
                    fs.delete(p, True)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive in ``ARRIVALS`` batches by hash of the id; each is appended as a run, all are compacted,
    and every live row is listed with its run, tier and file."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    by = free_names(docs, "arrival")[0]
    store.append_all(docs.withColumn(by, F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(ARRIVALS))), by)
    version = store.compact()
    live = store.read()
    if live is None:
        live = docs.drop("_shard_run", "_shard_tier", "_shard_file").withColumns({"_shard_run": F.lit(""), "_shard_tier": F.lit(0), "_shard_file": F.lit(0)})
    return live.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.col("_shard_run").alias("run"), F.col("_shard_tier").alias("tier"), F.col("_shard_file").alias("file"), F.lit(version).alias("version"))
