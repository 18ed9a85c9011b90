"""Zipped turbine exports as a Spark data source, and a writer of such archives.

The source has one partition a member, or with more than ``MAX_PARTITIONS`` members one for some members of an archive in a row.  A member's name holds the turbine and the days that it covers, so of wanted turbines and times
the members that can't have rows are never opened; the rows are filtered as well.  Only the wanted columns are parsed.

What is wanted is given to ``zipped_exports`` and not pushed down by Spark: Spark 4.1 keeps the partitions of a Python source's first
planning for a DataFrame, so that a later query on it with other filters would miss members.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from windloom.session import shared_folder
from windloom.sources import scada

NAME = "windloom_zipped_exports"
#: About so many partitions at most (an archive's last one may be smaller).
MAX_PARTITIONS = 256
#: ``..._<turbine>_<first day>_-_<day after the last>_...csv`` in a member's name; the days may be missing.
MEMBER = re.compile(r"_(\d+)_(\d{4}-\d\d-\d\d)?(?:_-_(\d{4}-\d\d-\d\d))?[^/]*\.csv$")


@dataclass
class Member(ds.InputPartition):
    archive: str
    name: str
    turbine: str
    first: str | None
    end: str | None
    size: int = 0
    #: Further members of the archive that the same task reads.
    more: list[Member] = field(default_factory=list)


@dataclass
class Wanted:
    """Turbines (None: all), and first and last time as ISO text; None: open."""

    turbines: list[str] | None = None
    since: str | None = None
    until: str | None = None

    def may_have(self, turbine: str, first: str | None, end: str | None) -> bool:
        """Whether a member of the turbine can have such rows; ``end``: the day after its last."""
        other = self.turbines is not None and turbine not in self.turbines
        early = end is not None and self.since is not None and end <= self.since[:10]
        late = first is not None and self.until is not None and first > self.until[:10]
        return not (other or early or late)


class Reader(ds.DataSourceReader):
    def __init__(self, archives: list[str], columns: dict[str, str], pattern: str, wanted: Wanted) -> None:
        self.archives, self.columns, self.pattern, self.wanted = archives, columns, pattern, wanted

    def partitions(self) -> list[Member]:
        out = []
        for archive in self.archives:
            with scada._archive(archive) as z:
                names = sorted((i.filename, i.file_size) for i in z.infolist() if re.search(self.pattern, i.filename))
            for name, size in names:
                found = MEMBER.search(name)
                turbine, first, end = (str(int(found.group(1))), *found.groups()[1:]) if found else (name, None, None)
                if self.wanted.may_have(turbine, first, end):
                    out.append(Member(archive, name, turbine, first, end, size))
        if len(out) <= MAX_PARTITIONS:
            return out
        share = sum(m.size for m in out) / MAX_PARTITIONS
        parts, held = [], 0
        for m in out:
            if parts and parts[-1].archive == m.archive and held + m.size <= share:
                parts[-1].more.append(m)
                held += m.size
            else:
                parts.append(m)
                held = m.size
        return parts

    def read(self, member: Member) -> Iterator[pa.RecordBatch]:
        with scada._archive(member.archive) as z:
            for m in (member, *member.more):
                yield from self._rows(z, m)

    def _rows(self, z: zipfile.ZipFile, member: Member) -> Iterator[pa.RecordBatch]:
        own = {v: k for k, v in self.columns.items()}
        with z.open(member.name) as raw:
            lines = io.TextIOWrapper(raw, "utf-8-sig", "replace", newline="")
            header = first = None
            for line in lines:
                if line.startswith("#"):
                    header = line if line.startswith("# Date and time") else header
                elif line.strip():
                    first = line
                    break
            if header is None:
                raise ValueError(f"{member.name}: no header line that begins with '# Date and time'")
            if first is None:
                return
            names = list(_names(header))
            for frame in pd.read_csv(scada._Joined(first, lines), names=names, usecols=list(own), chunksize=scada.CHUNK_LINES):
                frame = frame.rename(columns=own)
                ts = pd.to_datetime(frame["ts"], errors="coerce", format="%Y-%m-%d %H:%M:%S")
                columns = [pa.array([member.turbine] * len(frame)), pa.array(ts).cast(pa.timestamp("us"))]
                columns += [pa.array(pd.to_numeric(frame[c], errors="coerce"), from_pandas=True).cast(pa.float64()) for c in self.columns if c != "ts"]
                batch = pa.RecordBatch.from_arrays(columns, ["turbine", "ts", *(c for c in self.columns if c != "ts")])
                yield batch.filter(pc.is_valid(batch.column(1)))


@lru_cache
def _names(header: str) -> tuple[str, ...]:
    return tuple(" ".join(str(c).split()) for c in pd.read_csv(io.StringIO(header.lstrip("# ")), nrows=0).columns)


class ZippedExports(ds.DataSource):
    """Options: ``archives``, JSON list of files; ``columns``, JSON object of names here (ts among them) to header names; ``pattern``;
    ``wanted``, JSON object with the fields of ``Wanted``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        columns = json.loads(self.options["columns"])
        return "turbine string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in columns if c != "ts")

    def reader(self, schema) -> Reader:
        return Reader(json.loads(self.options["archives"]), json.loads(self.options["columns"]), self.options.get("pattern", r"Turbine_Data_.*\.csv$"), Wanted(**json.loads(self.options.get("wanted", "{}"))))


def zipped_exports(
    spark: SparkSession, path: str, columns: dict[str, str], pattern: str = r"Turbine_Data_.*\.csv$", turbines: list[str] | None = None, since: dt.datetime | None = None, until: dt.datetime | None = None
) -> DataFrame:
    """``(turbine, ts, other columns)`` of the archives under a path or pattern; ``columns``: names here to names in the header.
    With ``turbines``, ``since`` and ``until`` (both included) only their rows, and only members that can have some are opened."""
    spark.dataSource.register(ZippedExports)
    archives = sorted(spark.read.format("binaryFile").load(path).inputFiles())
    wanted = {"turbines": turbines, "since": since and since.isoformat(), "until": until and until.isoformat()}
    options = {"archives": json.dumps(archives), "columns": json.dumps(columns), "pattern": pattern, "wanted": json.dumps(wanted)}
    rows = spark.read.format(NAME).options(**options).load()
    if turbines is not None:
        rows = rows.where(F.col("turbine").isin(turbines))
    if since is not None:
        rows = rows.where(F.col("ts") >= F.lit(since.isoformat(" ")).cast("timestamp_ntz"))
    return rows if until is None else rows.where(F.col("ts") <= F.lit(until.isoformat(" ")).cast("timestamp_ntz"))


def write_exports(rows: DataFrame, name: str, comments: int = 9) -> str:
    """A new shared folder with ``rows(turbine, ts, wind, power)`` as zipped exports: an archive for each range of (turbine, ts), in which
    a turbine's rows are a member."""
    from pyarrow import fs

    path = shared_folder(rows.sparkSession, name)
    own = rows.select(F.col("turbine").cast("string").alias("turbine"), F.col("ts").cast("timestamp_ntz").alias("ts"), "wind", "power").where("turbine is not null and ts is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        files, root = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path)) if ":" in path else (fs.LocalFileSystem(), path)
        files.create_dir(root, recursive=True)
        archive = f"{root}/{uuid.uuid4().hex}.zip"
        held, n = None, 0

        def finish(z, held) -> None:
            turbine, part = held
            part = pd.concat(part)
            first, end = part["ts"].min().date(), part["ts"].max().date() + dt.timedelta(days=1)
            text = "".join(f"# export, line {k}\n" for k in range(comments)) + "# Date and time,Wind speed (m/s),Power (kW)\n"
            z.writestr(f"Turbine_Data_Farm_{turbine}_{first}_-_{end}_{n}.csv", text + part[["ts", "wind", "power"]].to_csv(index=False, header=False, date_format="%Y-%m-%d %H:%M:%S"))

        with files.open_output_stream(archive) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for pdf in batches:
                for turbine, part in pdf.groupby("turbine", sort=False):
                    if held is not None and (held[0] != turbine or sum(map(len, held[1])) > scada.CHUNK_LINES):
                        finish(z, held)
                        held, n = None, n + 1
                    held = held or (turbine, [])
                    held[1].append(part)
            if held is not None:
                finish(z, held)
                n += 1
        yield pd.DataFrame({"archive": [archive], "members": [n]})

    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    made = own.repartitionByRange(parts, "turbine", "ts").sortWithinPartitions("turbine", "ts").mapInPandas(run, "archive string, members int")
    made.write.mode("append").parquet(f"{path}/_written")
    return path
