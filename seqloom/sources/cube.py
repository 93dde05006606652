"""Text interchange format of (t, s, g, val) cubes, as a Spark data source named ``cube``.

A file has three header lines (total times, samples, genes), then for each time a line ``Time <TAB> i``, a line of column
names ``ID <TAB> NAME <TAB> S-0 ...`` and a line for each gene.  0 and empty cells are missing.  Each file is read by
one task and line by line; each task writes one file.
"""

from __future__ import annotations

import glob
import os
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "t int, s int, g long, val double"


def parse(lines):
    """(t, s, g, val) of a cube text's lines; missing values are left out."""
    t = None
    for line in lines:
        cells = line.rstrip("\n").split("\t")
        if cells[0].startswith("Total"):
            continue
        if cells[0] == "Time":
            t = int(cells[1])
        elif cells[0] != "ID" and t is not None and len(cells) > 2:
            for s, x in enumerate(cells[2:]):
                if x.strip() and float(x) != 0:
                    yield t, s, int(cells[1].removeprefix("G-")), float(x)


def render(rows) -> str:
    """A cube text of (t, s, g, val) rows."""
    values = {(t, s, g): v for t, s, g, v in rows if v is not None}
    ts, ss, gs = (sorted({k[i] for k in values}) for i in range(3))
    out = [f"Total Times:\t{len(ts)}", f"Total Samples:\t{len(ss)}", f"Total Genes:\t{len(gs)}"]
    for t in ts:
        out += [f"Time\t{t}", "\t".join(["ID", "NAME", *[f"S-{s}" for s in range(max(ss, default=-1) + 1)]])]
        out += ["\t".join([str(i), f"G-{g}", *[repr(values.get((t, s, g), 0)) for s in range(max(ss) + 1)]]) for i, g in enumerate(gs)]
    return "\n".join(out) + "\n"


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_File(p) for p in sorted(glob.glob(os.path.join(self.path, "*.tab")) if os.path.isdir(self.path) else glob.glob(self.path))]

    def read(self, partition):
        with open(partition.path, encoding="utf-8") as f:
            yield from parse(f)


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows):
        got = [tuple(r) for r in rows]
        name = os.path.join(self.path, f"{uuid.uuid4().hex}.tab")
        if got:
            os.makedirs(self.path, exist_ok=True)
            with open(name + ".part", "w", encoding="utf-8") as f:
                f.write(render(got))
            os.replace(name + ".part", name)
        return WriterCommitMessage()


class CubeSource(DataSource):
    @classmethod
    def name(cls):
        return "cube"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])
