"""Sizes of executors for a workload: a pure function of cores, memory and data.

Only settings that a running session takes are applied to it; the others are for the submitter.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import SparkSession

#: By kind of work, how well it runs in parallel, what it leans on, and its duration factor.
KINDS = {
    "text_extraction": (0.8, {"io"}, 0.5),
    "llm_processing": (0.6, {"memory", "cpu"}, 2.0),
    "audio_generation": (0.7, {"io", "cpu"}, 1.5),
    "validation": (0.9, {"cpu"}, 0.3),
    "general": (0.7, {"cpu"}, 1.0),
}
MOST_EXECUTORS, MOST_CORES, MOST_MEMORY = 20, 8, 16
PARTITION_MB = 128


@dataclass(frozen=True)
class Workload:
    data_mb: float
    kind: str = "general"
    complexity: float = 5.0

    @property
    def parallel(self) -> float:
        return KINDS.get(self.kind, KINDS["general"])[0]

    @property
    def leans_on(self) -> set[str]:
        return KINDS.get(self.kind, KINDS["general"])[1]

    @property
    def minutes(self) -> float:
        return self.data_mb / 100 * self.complexity * KINDS.get(self.kind, KINDS["general"])[2]


@dataclass(frozen=True)
class Sizes:
    executors: int
    cores: int
    memory_gb: int
    driver_gb: int
    shuffle_partitions: int
    broadcast_mb: int
    result_gb: int


@dataclass(frozen=True)
class Strategy:
    """What sets a strategy apart; sizes follow from it in one way for all."""

    executors: callable  # of (cores, parallel share)
    cores: int  # most of an executor
    share: float | None  # of all memory that executors split; None: they split it with the driver
    most_gb: int
    driver: float  # of an executor's memory
    driver_gb: int  # at least
    waves: int  # shuffle partitions for each core
    by_data: bool = False
    broadcast_mb: int = 100
    result_gb: int = 2
    least_cores: int = 1


STRATEGIES = {
    "conservative": Strategy(lambda c, p: max(1, min(4, c // 2)), 2, None, 4, 0.5, 1, 2, result_gb=1),
    "balanced": Strategy(lambda c, p: max(1, int(min(MOST_EXECUTORS, int(c * 0.8)) * p)), MOST_CORES, None, MOST_MEMORY, 0.6, 2, 2, True, 200),
    "aggressive": Strategy(lambda c, p: min(MOST_EXECUTORS, max(2, int(c * 0.9))), MOST_CORES, 0.8, MOST_MEMORY, 0.7, 2, 4, False, 512, 4, 2),
    "memory_optimized": Strategy(lambda c, p: max(1, min(6, c // 3)), 4, 0.9, MOST_MEMORY, 0.8, 3, 2, False, 1024, 8),
    "cpu_optimized": Strategy(lambda c, p: max(1, min(MOST_EXECUTORS, c // 2)), MOST_CORES, None, 6, 0.5, 1, 8, False, 100, 2, 2),
}


def sizes(work: Workload, cores: int, memory_gb: float, strategy: str = "balanced") -> Sizes:
    s = STRATEGIES[strategy]
    n = s.executors(cores, work.parallel)
    own = min(s.cores, max(s.least_cores, cores // n))
    memory = memory_gb / (n + 1) if s.share is None else memory_gb * s.share / n
    if strategy == "balanced" and "memory" in work.leans_on:
        memory *= 1.5
    memory = min(s.most_gb, memory)
    partitions = n * own * s.waves
    if s.by_data:
        partitions = max(partitions, int(work.data_mb / PARTITION_MB))
    return within(Sizes(n, own, int(memory), max(s.driver_gb, int(memory * s.driver)), partitions, s.broadcast_mb, s.result_gb), cores, memory_gb)


def within(found: Sizes, cores: int, memory_gb: float) -> Sizes:
    """Sizes that the machine has room for."""
    n = found.executors
    if n * found.cores > cores:
        n = min(n, cores // found.cores)
    n = max(1, min(MOST_EXECUTORS, n))
    room, wanted = memory_gb * 0.9, n * found.memory_gb + found.driver_gb
    scale = min(1.0, room / wanted) if wanted else 1.0
    fit = (lambda gb: max(1, int(gb * scale))) if scale < 1 else (lambda gb: gb)
    return replace(found, executors=n, cores=max(1, min(MOST_CORES, found.cores)), memory_gb=fit(found.memory_gb), driver_gb=fit(found.driver_gb))


def recommend(work: Workload) -> str:
    """A strategy for a workload."""
    if "memory" in work.leans_on:
        return "memory_optimized"
    if work.minutes > 60:
        return "aggressive"
    return "cpu_optimized" if work.complexity > 7 else "balanced"


def apply(spark: SparkSession, found: Sizes) -> None:
    spark.conf.set("spark.sql.shuffle.partitions", str(found.shuffle_partitions))


def submit_settings(found: Sizes) -> dict[str, str]:
    f = asdict(found)
    return {
        "spark.executor.instances": str(f["executors"]),
        "spark.executor.cores": str(f["cores"]),
        "spark.executor.memory": f"{f['memory_gb']}g",
        "spark.driver.memory": f"{f['driver_gb']}g",
        "spark.driver.maxResultSize": f"{f['result_gb']}g",
    }
