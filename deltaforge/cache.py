"""Caches: base models held in memory by last use, and rebuilt models on disk with the jobs that rebuild them."""

from __future__ import annotations

import hashlib
import json
import threading
import time
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaforge.plans import artifact, lossy
from deltaforge.session import shared_dir
from deltaforge.sources.tensors import load_tensors


class BaseModelCache:
    """Persisted models, the least recently used of which go when there is too much; one too large for all is held alone."""

    def __init__(self, spark: SparkSession, max_gb: float = 20.0):
        self.spark, self.max_gb, self.held = spark, max_gb, {}
        self.hits = self.misses = 0

    def get(self, path: str) -> DataFrame:
        if path in self.held:
            self.hits += 1
        else:
            self.misses += 1
            blocks = load_tensors(self.spark, path)
            size = 2 * (blocks.agg(F.sum(F.size("values").cast("long"))).first()[0] or 0) / 2**30
            self._evict(size)
            self.held[path] = {"blocks": blocks.persist(), "gb": size}
        self.held[path]["used"] = time.monotonic()
        return self.held[path]["blocks"]

    def _evict(self, more: float) -> None:
        for path in outlived([(p, m["gb"], m["used"]) for p, m in self.held.items()], self.max_gb - more):
            self.held.pop(path)["blocks"].unpersist()

    def size_gb(self) -> float:
        return sum(m["gb"] for m in self.held.values())

    def clear(self) -> None:
        for m in self.held.values():
            m["blocks"].unpersist()
        self.held = {}

    def stats(self) -> dict:
        return {"models": list(self.held), "size_gb": self.size_gb(), "max_gb": self.max_gb, "hits": self.hits, "misses": self.misses}


_caches: dict[str, BaseModelCache] = {}
_rebuilt: dict[str, DeltaCache] = {}


def get_cache(spark: SparkSession, max_gb: float = 20.0) -> BaseModelCache:
    """The application's cache; the first call sets its size."""
    return _caches.setdefault(spark.sparkContext.applicationId, BaseModelCache(spark, max_gb))


def get_global_cache(spark: SparkSession, root: str | None = None, max_gb: float = 50.0) -> DeltaCache:
    """The application's cache of rebuilt models; the first call says where it lies, by default in the shared folder."""
    key = spark.sparkContext.applicationId
    if key not in _rebuilt:
        _rebuilt[key] = DeltaCache(spark, root or f"{shared_dir(spark)}/deltaforge-cache", max_gb)
    return _rebuilt[key]


def outlived(entries: list[tuple[str, float, float]], limit: float) -> list[str]:
    """Of (key, size, last use) those that go, longest unused first, until the rest is within ``limit``; ties by key, the larger first."""
    total, gone = sum(size for _, size, _ in entries), []
    for key, size, _ in sorted(sorted(entries, key=lambda e: e[0], reverse=True), key=lambda e: e[2]):
        if total <= limit:
            break
        gone.append(key)
        total -= size
    return gone


@dataclass
class Job:
    key: str
    base: str
    delta: str
    status: str = "pending"
    error: str | None = None
    path: str | None = None
    future: Future | None = field(default=None, repr=False)


class DeltaCache:
    """Models rebuilt from artifacts, by what base and artifact hold rather than where they lie, so none goes stale.

    A base's content is read for its hash when its files have changed since they were last read.

    A rebuilt model counts when Spark has marked it whole. Jobs run in threads of the driver in a scheduler pool of their
    own; a job that has failed starts again when asked for, one that waits or runs doesn't.
    """

    def __init__(self, spark: SparkSession, root: str, max_gb: float = 50.0, workers: int = 2):
        self.spark, self.root, self.max_gb = spark, root.rstrip("/"), max_gb
        self.jobs: dict[str, Job] = {}
        self.lock = threading.Lock()
        self.pool = ThreadPoolExecutor(workers)
        self.index = self._read()
        self.hashes: dict[str, tuple[str, str]] = {}

    def _read(self) -> dict:
        empty = {"hits": 0, "misses": 0, "entries": {}}
        return json.loads(artifact.read_text(self.spark, f"{self.root}/index.json")) if artifact.exists(self.spark, f"{self.root}/index.json") else empty

    def _save(self) -> None:
        artifact.write_text(self.spark, f"{self.root}/index.json", json.dumps(self.index))

    def key(self, base: str, delta: str) -> str:
        return hashlib.md5(f"{self._content(base)}:{artifact.read_text(self.spark, f'{delta}/manifest.json')}".encode()).hexdigest()[:16]

    def _content(self, base: str) -> str:
        """The base's hash; read again when names, sizes or times of its files are others."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(base)
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
        seen = []
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
        state = "\n".join(sorted(seen))
        if self.hashes.get(base, ("", ""))[0] != state:
            self.hashes[base] = state, artifact.model_hash(load_tensors(self.spark, base))
        return self.hashes[base][1]

    def path(self, key: str) -> str:
        return f"{self.root}/reconstructed/{key}"

    def is_reconstructed(self, base: str, delta: str) -> bool:
        return artifact.exists(self.spark, f"{self.path(self.key(base, delta))}/_SUCCESS")

    def reconstructed_path(self, base: str, delta: str) -> str | None:
        """Where the rebuilt model lies, if it does; counts as a hit or a miss."""
        with self.lock:
            key = self.key(base, delta)
            found = artifact.exists(self.spark, f"{self.path(key)}/_SUCCESS")
            self.index["hits" if found else "misses"] += 1
            if found and key in self.index["entries"]:
                self.index["entries"][key]["used"] = time.time()
            self._save()
        return self.path(key) if found else None

    def get_or_reconstruct(self, base: str, delta: str, background: bool = False, poll: float = 0.5) -> str | None:
        """The rebuilt model's path; in the background None until it is there."""
        if found := self.reconstructed_path(base, delta):
            return found
        key = self.key(base, delta)
        with self.lock:
            job = self.jobs.get(key)
            if job is None or job.status in ("failed", "completed"):
                job = self.jobs[key] = Job(key, base, delta)
                job.future = self.pool.submit(inheritable_thread_target(self.spark)(self._run), job)
        if background:
            return job.path
        while not job.future.done():
            time.sleep(min(poll, 0.05))
        job.future.result()
        return job.path

    def _run(self, job: Job) -> None:
        job.status = "running"
        try:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", "reconstruct")
            began, path = time.time(), self.path(job.key)
            rebuild(load_tensors(self.spark, job.base), job.delta).write.mode("overwrite").parquet(path)
            with self.lock:
                self.index["entries"][job.key] = {"base": job.base, "delta": job.delta, "seconds": time.time() - began, "used": time.time()}
                self._evict(job.key)
                self._save()
            job.path, job.status = path, "completed"
        except Exception as e:
            job.status, job.error = "failed", str(e)
            raise

    def _evict(self, keep: str) -> None:
        """Delete those used longest ago while all are larger than allowed."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()

        def size(key: str) -> float:
            where = jvm.org.apache.hadoop.fs.Path(self.path(key))
            fs = where.getFileSystem(conf)
            return fs.getContentSummary(where).getLength() / 2**30 if fs.exists(where) else 0.0

        entries = [(k, size(k), e["used"] if k != keep else float("inf")) for k, e in self.index["entries"].items()]
        for k in outlived(entries, self.max_gb):
            if k != keep:
                where = jvm.org.apache.hadoop.fs.Path(self.path(k))
                where.getFileSystem(conf).delete(where, True)
                del self.index["entries"][k]

    def prefetch(self, pairs: list[tuple[str, str]]) -> list[str]:
        """Start rebuilding several; their keys."""
        for base, delta in pairs:
            self.get_or_reconstruct(base, delta, background=True)
        return [self.key(*p) for p in pairs]

    def job_status(self, key: str) -> str | None:
        return self.jobs[key].status if key in self.jobs else None

    def stats(self) -> dict:
        jobs = [{k: v for k, v in asdict_job(j).items()} for j in self.jobs.values()]
        return {"hits": self.index["hits"], "misses": self.index["misses"], "entries": len(self.index["entries"]), "jobs": jobs}


def asdict_job(job: Job) -> dict:
    future, job.future = job.future, None
    try:
        return {k: v for k, v in asdict(job).items() if k != "future"}
    finally:
        job.future = future


def rebuild(base: DataFrame, folder: str, strict: bool = False) -> DataFrame:
    """A model in block form from an artifact of any type: differences, low-rank factors or an adapter."""
    kind = artifact.read_manifest(base.sparkSession, folder).get("type", "model_delta")
    known = {"model_delta": artifact.reconstruct_model, "svd_delta": lossy.reconstruct, "adapter": artifact.reconstruct_adapter}
    if kind not in known:
        raise ValueError(f"{folder} is no model but a {kind}")
    return known[kind](base, folder, strict=strict)


def load(spark: SparkSession, path: str, base: str | None = None, mode: str = "auto", cache: DeltaCache | None = None, splits: list[str] | None = None) -> DataFrame:
    """What ``path`` stands for: a model rebuilt from an artifact of any type, in block form; a dataset's rows, if it is a
    dataset's artifact (``base`` is then Parquet with ``pos``); a model read as it is, otherwise or with mode ``full_only``.
    """
    if mode not in ("auto", "prefer_delta", "full_only"):
        raise ValueError(mode)
    if mode == "full_only" or not artifact.exists(spark, f"{path}/manifest.json"):
        return load_tensors(spark, path)
    manifest = artifact.read_manifest(spark, path)
    base = base or manifest["base_id"]
    if manifest.get("type") == "dataset_delta":
        return artifact.reconstruct_dataset(spark.read.parquet(base), path, splits)
    if cache is not None:
        return spark.read.parquet(cache.get_or_reconstruct(base, path))
    return rebuild(load_tensors(spark, base), path)
