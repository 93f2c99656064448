"""Session settings for batch text jobs, and the settings of a retrieval run."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

#: Settings that hold at every size; partition counts and memory belong to the cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "sparkquill", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | extra)
    return (builder.master(master) if master else builder).getOrCreate()


@dataclass(frozen=True)
class Settings:
    """What a run may choose; `Settings.load` takes it from variables with the prefix SPARKQUILL_ (SPARKQUILL_TOP_K=8)."""

    retriever: str = "hybrid_header"
    top_k: int = 5
    chunk_size: int = 300
    chunk_overlap: int = 50
    price_in: float = 0.0
    price_out: float = 0.0

    @classmethod
    def load(cls, env: dict[str, str] | None = None, dotenv: str | None = None, prefix: str = "SPARKQUILL_") -> Settings:
        """Variables of the process (or `env`) come before those of the file `dotenv`; a value of the wrong kind is an error."""
        found: dict[str, str] = {}
        if dotenv and os.path.exists(dotenv):
            with open(dotenv, encoding="utf-8") as lines:
                for line in lines:
                    name, sign, value = line.strip().partition("=")
                    if sign and not name.startswith("#"):
                        found[name.strip()] = value.strip().strip("\"'")
        found |= os.environ if env is None else env
        kinds = {"str": str, "int": int, "float": float}
        return cls(**{f.name: kinds[f.type](found[prefix + f.name.upper()]) for f in fields(cls) if found.get(prefix + f.name.upper(), "") != ""})

    def depth(self, asked: int | None) -> int:
        """How many passages a question gets: none or 0 asked means the default."""
        return asked or self.top_k
