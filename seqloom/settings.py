"""Settings of a run over a cube: read once from a flat ``name: value`` file, never global."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import PurePosixPath

from pyspark.sql import SparkSession

#: Folders below the top one, by what they hold.
FOLDERS = {
    "static_baseline": "baselines/static", "temporal_baseline": "baselines/temporal", "tab": "tab_files", "triclusters": "triclusters", "biclusters": "biclusters", "tricluster_matrices": "matrices/trics",
    "bicluster_matrices": "matrices/bics", "results": "results/bictric", "tricluster_results": "results/tric-based", "baseline_results": "results/baseline", "trajectories": "trajectories", "visualization": "visualization",
}


@dataclass(frozen=True)
class Settings:
    """What a run needs; ``folder`` names the places that follow from the top folder."""

    top_folder: str
    data_file: str = ""
    snapshots_file: str = ""
    min_app: int = 1
    n_clust: int = 2
    ref_feature: str = ""
    include_static: bool = False

    def folder(self, what: str) -> str:
        return str(PurePosixPath(self.top_folder) / FOLDERS[what])


def parse(text: str) -> Settings:
    """Settings of ``name: value`` lines, names in any case; # starts a comment, quotes around values go, other names are errors."""
    kinds = {f.name: f.type for f in fields(Settings)}
    given = {}
    for line in text.splitlines():
        name, colon, value = line.partition("#")[0].strip().partition(":")
        if not name:
            continue
        name, value = name.strip().lower(), value.strip().strip("\"'")
        if not colon or name not in kinds:
            raise ValueError(f"not a setting: {line!r}")
        given[name] = value.lower() in ("true", "yes", "1") if kinds[name] == "bool" else int(value) if kinds[name] == "int" else value
    return Settings(**given)


def load(spark: SparkSession, path: str) -> Settings:
    """Settings of a file on any store that Spark reads."""
    return parse(spark.read.text(path, wholetext=True).first()[0])
