"""Token shards as a data source: files of little-endian unsigned 16-bit ids, written with a commit and read by ranges of bytes.

Writing: each attempt of a task writes files of its own below `_attempts`, and says in its message which
shards they hold. Only the commit, on the driver, moves the files of the attempts that count to their
names and then writes the manifest, through a temporary name; so a killed, failed or repeated attempt
leaves neither a wrong shard nor a wrong manifest. A commit moves one file for each shard; one that is
broken off in between leaves a mark, with which the folder isn't read until it has been written anew.

Reading: documents begin with a delimiter id, and a range of bytes holds the documents that begin in
it. A task looks for the first delimiter in its range and reads on past the range's end up to the next
one, so that nothing is shuffled and each document comes from one task, whole. What comes before
a file's first delimiter belongs to no document and is left out.

Folders are addresses that pyarrow's file systems open on the driver and on every executor.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a range, and of what is read of it at once.
RANGE_BYTES, READ_BYTES = 32 << 20, 4 << 20
#: Ids of the documents that go out in one batch, at least one document.
BATCH_IDS = 1 << 20
ATTEMPTS, MANIFEST, OPEN = "_attempts", "_shards.json", "_committing"
DOCUMENTS = "name string, start long, tokens array<int>"
WRITTEN = pa.schema([("name", pa.string()), ("start", pa.int64()), ("tokens", pa.list_(pa.int32()))])


def shard_name(shard: int) -> str:
    return f"shard_{shard:04d}.bin"


def opened(folder: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if ":/" in folder else "file://" + folder)


@dataclass
class Written(WriterCommitMessage):
    """What one attempt of a task wrote: shards by number, with their ids' count, in a folder of its own."""

    attempt: str
    shards: dict[int, int]


@dataclass
class Range(InputPartition):
    """The documents of a file that begin in bytes [low, high)."""

    path: str
    low: int
    high: int
    size: int


class ShardWriter(DataSourceArrowWriter):
    """Takes rows (shard, tokens), all rows of a shard in one task and in order. With `overwrite`, the shards of an earlier manifest go when the new one is complete."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base = opened(self.folder)
        attempt, counts, out, last = f"{ATTEMPTS}/{self.job}/{uuid.uuid4().hex}", {}, None, None
        system.create_dir(f"{base}/{attempt}", recursive=True)
        try:
            for batch in batches:
                rows = batch.column(1)
                ids, ends = rows.flatten().to_numpy(zero_copy_only=False), np.cumsum(_sizes(rows))
                if len(ids) and not 0 <= ids.min() <= ids.max() < 65536:
                    raise ValueError("token ids must fit 16 bits")
                data = ids.astype("<u2")
                for shard, first, end in _runs(batch.column(0).to_numpy(zero_copy_only=False), ends):
                    if shard != last:
                        if shard in counts:
                            raise ValueError(f"the rows of shard {shard} don't come one after the other")
                        if out is not None:
                            out.close()
                        out, last = system.open_output_stream(f"{base}/{attempt}/{shard_name(shard)}"), shard
                        counts[shard] = 0
                    out.write(data[first:end].tobytes())
                    counts[shard] += end - first
        finally:
            if out is not None:
                out.close()
        return Written(attempt, counts)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = opened(self.folder)
        found = [m for m in messages if m is not None]
        counts = {shard: n for m in found for shard, n in m.shards.items()}
        if len(counts) < sum(len(m.shards) for m in found):
            self.abort(messages)
            raise ValueError("a shard comes from two tasks: deal the rows by shard")
        names = {shard_name(s): n for s, n in sorted(counts.items())}
        earlier = set(committed(self.folder))
        if earlier and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.folder} holds shards")
        system.open_output_stream(f"{base}/{OPEN}").close()  # readers refuse the folder until the new manifest is there
        for m in found:
            for shard in m.shards:
                system.move(f"{base}/{m.attempt}/{shard_name(shard)}", f"{base}/{shard_name(shard)}")
        for name in earlier - set(names):
            system.delete_file(f"{base}/{name}")
        with system.open_output_stream(f"{base}/{MANIFEST}.tmp") as out:
            out.write(json.dumps({"num_shards": len(names), "token_counts": names}).encode())
        system.move(f"{base}/{MANIFEST}.tmp", f"{base}/{MANIFEST}")
        system.delete_file(f"{base}/{OPEN}")
        self._clear(system, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.folder))

    def _clear(self, system, base: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{base}/{ATTEMPTS}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{ATTEMPTS}/{self.job}")
        # another job may be writing beside this one
        if system.get_file_info(f"{base}/{ATTEMPTS}").type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(f"{base}/{ATTEMPTS}")):
            system.delete_dir(f"{base}/{ATTEMPTS}")


def _sizes(rows: pa.ListArray) -> np.ndarray:
    """Lengths of lists; null is empty."""
    return np.nan_to_num(rows.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)


def _runs(shards: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Of rows with a shard and the place where their ids end: each run of one shard, with the places of its ids."""
    borders = np.flatnonzero(np.diff(shards)) + 1
    for first, last in zip([0, *borders], [*borders, len(shards)]):
        if last > first:
            yield int(shards[first]), int(ends[first - 1]) if first else 0, int(ends[last - 1])


def committed(folder: str) -> dict[str, int]:
    """Names and counts of ids by the folder's manifest; empty without one."""
    from pyarrow import fs

    system, base = opened(folder)
    if system.get_file_info(f"{base}/{MANIFEST}").type != fs.FileType.File:
        return {}
    with system.open_input_file(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())["token_counts"]


class ShardReader(DataSourceReader):
    def __init__(self, folder: str, delimiter: int, range_bytes: int):
        self.folder, self.delimiter, self.range_bytes = folder, delimiter, range_bytes - range_bytes % 2

    def partitions(self) -> list[Range]:
        """A row for each range of a file; a manifest, if there is one, says which files count, else all .bin files do."""
        from pyarrow import fs

        system, base = opened(self.folder)
        if system.get_file_info(f"{base}/{OPEN}").type != fs.FileType.NotFound:
            raise ValueError(f"{self.folder}: a write was broken off")
        known, out = committed(self.folder), []
        for info in sorted(system.get_file_info(fs.FileSelector(base)), key=lambda x: x.path):
            if info.type == fs.FileType.File and info.base_name.endswith(".bin") and (not known or info.base_name in known):
                if known and info.size != 2 * known[info.base_name]:
                    raise ValueError(f"{info.path} has {info.size} bytes, the manifest says {known[info.base_name]} ids")
                out += [Range(info.path, low, min(low + self.range_bytes, info.size), info.size) for low in range(0, info.size - info.size % 2, self.range_bytes)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = opened(self.folder)
        name = partition.path.rsplit("/", 1)[-1]
        with system.open_input_file(partition.path) as f:
            yield from documents(f, name, partition.low, partition.high, partition.size - partition.size % 2, self.delimiter)


def documents(f, name: str, low: int, high: int, size: int, delimiter: int, step: int = READ_BYTES) -> Iterator[pa.RecordBatch]:
    """The documents of an open file that begin in bytes [low, high), in batches: what is held is a batch, or the one document that is longer."""
    held, start = [], None  # ids of the document that is open, in pieces, and where it began
    texts, sizes, starts, waiting = [], [], [], 0

    def flushed() -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(texts).astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array([name] * len(sizes)), pa.array(starts, pa.int64()), tokens], schema=WRITTEN)

    at = low
    while at < size and (at < high or start is not None):
        f.seek(at)
        # within the range by large steps; beyond it only the end of the last document is wanted
        ids = np.frombuffer(f.read(min(step if at < high else step // 16, (high if at < high else size) - at) & ~1 or 2), "<u2")
        places = np.flatnonzero(ids == delimiter)
        begins = at // 2 + places
        if at >= high:
            places, begins = places[:1], begins[:1]
        borders = [0, *places.tolist(), len(ids)]
        for k, (a, b) in enumerate(zip(borders, borders[1:])):
            if k and start is not None:  # a delimiter closes what was open
                texts.append(np.concatenate(held))
                sizes.append(len(texts[-1])), starts.append(start)
                waiting += sizes[-1]
                held, start = [], None
                if waiting >= BATCH_IDS:
                    yield flushed()
                    texts, sizes, starts, waiting = [], [], [], 0
            if k and at < high:
                start = int(begins[k - 1])
            if start is not None and b > a:
                held.append(ids[a:b])
        at += 2 * len(ids)
    if start is not None:
        texts.append(np.concatenate(held))
        sizes.append(len(texts[-1])), starts.append(start)
    if sizes:
        yield flushed()


class TokenShards(DataSource):
    """Format `token_shards`: options path, delimiter (reading) and range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return DOCUMENTS

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"], int(self.options["delimiter"]), int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], overwrite)
