"""Parameters of an assembly, and the reader of configuration files."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    """q_min: a neighbour base counts if its quality is above it; d_min: and is valid if it counts so often.

    min_contig_len None stands for 2 * k. quality_offset is that of the files; wrap_quality takes decoded qualities modulo 256, as 8-bit
    readers do, and raises on qualities below the offset otherwise.
    """

    q_min: int = 19
    d_min: int = 10
    k: int = 41
    min_contig_len: int | None = None
    fasta_textwidth: int = 50
    quality_offset: int = 64
    wrap_quality: bool = True
    mode: str = "FAILFAST"

    def __post_init__(self):
        if self.k < 1 or self.d_min < 1 or self.fasta_textwidth < 1:
            raise ValueError("k, d_min and fasta_textwidth must be positive")
        if self.mode not in ("FAILFAST", "DROP"):
            raise ValueError("mode is FAILFAST or DROP")

    @property
    def least_length(self) -> int:
        return 2 * self.k if self.min_contig_len is None else self.min_contig_len


#: Keys of a configuration file's block.
KEYS = {"Q_MIN": "q_min", "D_MIN": "d_min", "K": "k", "MIN_CONTIG_LEN": "min_contig_len", "FASTA_TEXTWIDTH": "fasta_textwidth"}


def parse_config(text: str) -> Config:
    """A block `defaults { KEY "value" ... }`; ; begins a comment, unknown keys are ignored, missing ones have their defaults."""
    text = re.sub(r";[^\n]*", "", text)
    block = re.search(r"\bdefaults\s*\{([^}]*)\}", text)
    found = dict(re.findall(r"(\w+)\s+\"?([^\s\"]+)\"?", block[1])) if block else {}
    return Config(**{KEYS[k]: int(v) for k, v in found.items() if k in KEYS})


def load_config(spark: SparkSession, path: str) -> Config:
    """The configuration at a path that Spark can read; the defaults where there is no such file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return Config()
    return parse_config("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))

