"""What every job needs: this package on the executors, lineage cuts, timers, memory and device facts."""

from __future__ import annotations

import ctypes
import gc
import os
import platform
import resource
import sys
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to all executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="gaussmill-")) / "gaussmill-src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only in local mode without the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="gaussmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables that one piece of work keeps in the shared folder until it says that nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def new_path(self, name: str) -> str:
        self.paths.append(f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}")
        return self.paths[-1]

    def written(self, df: DataFrame, name: str = "step", options: dict | None = None) -> DataFrame:
        """The same rows from a Parquet table in the shared folder: lineage ends here and outlives executors."""
        path = self.new_path(name)
        df.write.options(compression="zstd", **(options or {})).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_last(self, count: int = 0) -> None:
        """Delete all tables but the last `count`."""
        gone, self.paths = (self.paths, []) if not count else (self.paths[:-count], self.paths[-count:])
        for name in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back(spark: SparkSession) -> None:
    """Return to the system what finished work left with the driver: its JVM's garbage, with the heap it no longer needs, and freed memory of its Python."""
    gc.collect()
    if pa := sys.modules.get("pyarrow"):
        pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)
    spark._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows from a table of their own in the shared folder, which stays."""
    return Scratch(df.sparkSession).written(df)


class Timer:
    """Wall and process time; several tic/toc intervals add up if `hold`."""

    def __init__(self, hold: bool = True):
        self.hold = hold
        self.reset()

    def reset(self) -> None:
        self.wall_time = self.proc_time = 0.0
        self.count = 0
        self._wall = self._proc = None

    def tic(self) -> None:
        self._wall, self._proc = time.perf_counter(), time.process_time()

    def toc(self) -> None:
        if self._wall is None:
            raise RuntimeError("toc without tic")
        wall, proc = time.perf_counter() - self._wall, time.process_time() - self._proc
        self.wall_time = self.wall_time + wall if self.hold else wall
        self.proc_time = self.proc_time + proc if self.hold else proc
        self.count += 1
        self._wall = self._proc = None


def human_readable(size: float) -> tuple[float, str]:
    for unit in ("b", "Kb", "Mb", "Gb", "Tb"):
        if abs(size) < 1024 or unit == "Tb":
            return size, unit
        size /= 1024
    raise AssertionError


class Memory:
    """Growth of the driver process's largest resident memory between start and stop."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self._begin = self._total = 0

    def start(self) -> None:
        self._begin = self.get_resident_memory()

    def stop(self) -> None:
        self._total += self.get_resident_memory() - self._begin

    def get_mem(self, human: bool = False):
        return human_readable(self._total) if human else self._total

    @staticmethod
    def get_resident_memory(human: bool = False):
        size = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
        return human_readable(size) if human else size


def get_processor_name() -> str:
    return platform.processor() or platform.machine()


def get_num_cpu_threads(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def get_num_gpu_devices(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.executor.resource.gpu.amount", "0"))


def get_gpu_name(spark: SparkSession) -> str:
    return "not found" if not get_num_gpu_devices(spark) else spark.conf.get("spark.executor.resource.gpu.vendor", "unknown")


def restrict_to_single_processor(builder: SparkSession.Builder) -> SparkSession.Builder:
    """A session builder with one task slot and single-threaded numerics, for fair timings."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS", "VECLIB_MAXIMUM_THREADS", "NUMEXPR_NUM_THREADS"):
        os.environ[name] = "1"
        builder = builder.config(f"spark.executorEnv.{name}", "1")
    return builder.master("local[1]")


def get_config(spark: SparkSession, key: str | None = None):
    """Facts about the engine's configuration: one value, or all."""
    facts = {"spark_version": spark.version, "master": spark.sparkContext.master, "adaptive": spark.conf.get("spark.sql.adaptive.enabled") == "true", "arrow_batch": int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions"))}
    return facts if key is None else facts[key]


def info(spark: SparkSession) -> DataFrame:
    """One row of versions and devices."""
    row = (spark.version, get_processor_name(), get_num_cpu_threads(spark), get_num_gpu_devices(spark), get_gpu_name(spark))
    return spark.createDataFrame([row], "spark_version string, processor string, num_cpu_threads int, num_gpu_devices int, gpu_name string")
