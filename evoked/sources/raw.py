"""Raw fixed-record recordings: interleaved int16 samples, as a Python data source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.channels = int(options["channels"])
        self.chunk = int(options.get("chunk", 65536))
        self.records = int(options["records"])

    def partitions(self) -> list[InputPartition]:
        """Ranges of whole records, each a multiple of the chunk, so a chunk is never split."""
        step = self.chunk * 16
        return [_Range(i, min(i + step, self.records)) for i in range(0, self.records, step)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        fs, path = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        size = 2 * self.channels
        with fs.open_input_file(path) as f:
            for start in range(partition.start, partition.stop, self.chunk):
                n = min(self.chunk, partition.stop - start)
                raw = f.read_at(n * size, start * size)
                data = np.frombuffer(raw, "<i2").reshape(-1, self.channels)
                if len(data) != n:
                    raise ValueError("the file is shorter than its records")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(self.channels), pa.int32()), pa.array([start // self.chunk] * self.channels, pa.int64()), pa.array([start] * self.channels, pa.int64()), pa.array(data.T.tolist(), pa.list_(pa.int16()))],
                    ["channel", "chunk_id", "start_sample", "samples"],
                )


class RawSource(DataSource):
    """spark.read.format("raw_int16").option("channels", n).option("records", r).load(path): one row a channel and chunk."""

    @classmethod
    def name(cls) -> str:
        return "raw_int16"

    def schema(self) -> str:
        return "channel int, chunk_id long, start_sample long, samples array<short>"

    def reader(self, schema) -> RawReader:
        return RawReader(self.options)


def records(size: int, channels: int) -> int:
    """Number of records in a file of `size` bytes, which must be a whole number."""
    if size % (2 * channels):
        raise ValueError(f"{size} bytes are no whole number of records of {channels} channels")
    return size // (2 * channels)


def tetrode_channels(k: int) -> list[int]:
    """Channels of tetrode k, from 1."""
    return list(range(4 * (k - 1), 4 * k))
