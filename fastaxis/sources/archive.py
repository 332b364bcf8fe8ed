"""Waveform archives: day files of miniSEED records, laid out by year, network, station and channel.

``ROOT/2026/HL/ATH/HHZ.D/HL.ATH..HHZ.D.2026.001``. Picks are dealt by station and day, and the
tasks find and read the files: nothing is listed or gathered on the driver, whatever the number of
picks. A day file's record headers are read once, in pieces of bounded size, into an index; of the
samples only those records are read and unpacked that a window touches. Records may be of any
length and order. Paths are opened by Arrow's file systems (local, HDFS, S3 and others).
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import numpy as np
import pandas as pd
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file read at once for its headers; day files of which a task keeps the index.
_CHUNK, _KEPT = 1 << 20, 16
#: Encodings of fixed width: numpy types without their byte order.
_PLAIN = {1: "i2", 3: "i4", 4: "f4", 5: "f8"}
#: Steim words beside those of whole bytes: (code, two further bits) to (bits, differences in a word).
_STEIM2 = {(2, 1): (30, 1), (2, 2): (15, 2), (2, 3): (10, 3), (3, 0): (6, 5), (3, 1): (5, 6), (3, 2): (4, 7)}


def steim(payload: bytes, count: int, order: str, second: bool) -> np.ndarray:
    """Samples of Steim-1 or Steim-2 frames: differences packed in words, summed up from the first sample.

    Bytes and pairs of bytes are in the order they are stored in, whatever the byte order of the words.
    """
    payload = payload[: len(payload) // 64 * 64]
    if not payload:
        return np.zeros(0)
    words = np.frombuffer(payload, f"{order}u4").astype(np.int64)
    codes = words[::16, None] >> (30 - 2 * np.arange(16)) & 3
    codes[:, 0] = 0
    codes[0, 1:3] = 0  # the first and the last sample
    code, size, value = codes.ravel(), np.zeros(len(words), int), np.zeros((len(words), 7), np.int64)

    def put(at: np.ndarray, differences: np.ndarray) -> None:
        size[at] = differences.shape[1]
        value[at, : differences.shape[1]] = differences[at]

    put(code == 1, np.frombuffer(payload, "i1").reshape(-1, 4))
    if second:
        for (kind, further), (bits, n) in _STEIM2.items():
            raw = words[:, None] >> bits * np.arange(n - 1, -1, -1) & (1 << bits) - 1
            put((code == kind) & (words >> 30 == further), raw - (raw >> bits - 1 << bits))
    else:
        put(code == 2, np.frombuffer(payload, f"{order}i2").reshape(-1, 2))
        put(code == 3, np.frombuffer(payload, f"{order}i4").reshape(-1, 1))
    if ((code > 0) & (size == 0)).any():
        raise ValueError("unknown packing of a Steim word")
    differences = value[np.arange(7) < size[:, None]]
    # The first difference leads from the record before.
    first = int(np.frombuffer(payload, f"{order}i4", 1, 4)[0])
    return np.cumsum([first, *differences[1:count]])[:count].astype(float)


def header(content: bytes, at: int = 0) -> tuple | None:
    """((network, station, location, channel), start in seconds, rate, samples, encoding, byte order, offset of the data, length) of the record there, None for what is no whole header."""
    head = content[at : at + 48]
    if len(head) < 48 or head[6:7] not in b"DRQM" or not head[:6].strip().isdigit():
        return None
    order = ">" if 1900 <= struct.unpack(">H", head[20:22])[0] <= 2100 else "<"
    year, day, hour, minute, second, _, fraction, count, factor, multiplier = struct.unpack(f"{order}HHBBBBHHhh", head[20:36])
    data_at, blockette = struct.unpack(f"{order}HH", head[44:48])
    encoding, data_order, length = None, ">", None
    while blockette and len(content) >= at + blockette + 8:
        kind, following = struct.unpack(f"{order}HH", content[at + blockette : at + blockette + 4])
        if kind == 1000:
            encoding, big, power = content[at + blockette + 4 : at + blockette + 7]
            data_order, length = ">" if big else "<", 1 << power
        # Blockettes only lead onwards.
        blockette = following if following > blockette else 0
    if length is None or length < 48:
        return None
    rate = (factor if factor > 0 else -1 / factor if factor else 0) * (multiplier if multiplier > 0 else -1 / multiplier if multiplier else 0)
    start = (datetime(year, 1, 1, hour, minute, second, tzinfo=timezone.utc) + timedelta(days=day - 1)).timestamp() + fraction / 10_000
    names = tuple(head[a:b].decode("ascii").strip() for a, b in ((18, 20), (8, 13), (13, 15), (15, 18)))
    return names, start, float(rate), count, encoding, data_order, data_at, length


def samples(content: bytes, found: tuple) -> np.ndarray:
    """The samples of one record's bytes."""
    _, _, _, count, encoding, order, data_at, length = found
    payload = content[data_at:length]
    if encoding in _PLAIN:
        return np.frombuffer(payload, order + _PLAIN[encoding], count).astype(float)
    if encoding in (10, 11):
        return steim(payload, count, order, encoding == 11)
    raise ValueError(f"encoding {encoding} is not supported")


def records(content: bytes) -> Iterator[tuple[str, str, str, str, float, float, np.ndarray]]:
    """(network, station, location, channel, start in seconds, rate, samples) of each record; what is no record ends the file."""
    at = 0
    while (found := header(content, at)) is not None:
        names, start, rate, count, *_, length = found
        if count and rate:
            yield (*names, start, rate, samples(content[at : at + length], found))
        at += length


class DayFile:
    """An open day file: ``index`` holds (offset, header) of its records, ``taken`` the bytes read for samples."""

    def __init__(self, stream):
        self.stream, self.index, self.taken = stream, [], 0
        at, begin, chunk = 0, 0, b""
        while True:
            # A header and its blockettes lie within 512 bytes.
            if at + 512 > begin + len(chunk):
                stream.seek(min(at, stream.size()))
                begin, chunk = at, stream.read(_CHUNK)
            found = header(chunk, at - begin)
            if found is None:
                break
            if found[3] and found[2]:
                self.index.append((at, found))
            at += found[7]

    def between(self, t0: float, t1: float) -> Iterator[tuple]:
        """The records that have samples of a window, read and unpacked."""
        for at, found in self.index:
            names, start, rate, count, *_, length = found
            if start <= t1 + 1 / rate and start + count / rate >= t0 - 1 / rate:
                self.stream.seek(at)
                content = self.stream.read(length)
                self.taken += len(content)
                yield (*names, start, rate, samples(content, found))


def segments(of: Iterator[tuple]) -> list[tuple]:
    """Records joined where one begins when the last ends, to half a sample."""
    out: list[tuple] = []
    for r in sorted(of, key=lambda r: (r[:4], r[4])):
        if out and out[-1][:4] == r[:4] and out[-1][5] == r[5] and abs(out[-1][4] + sum(map(len, out[-1][6])) / r[5] - r[4]) * r[5] < 0.5:
            out[-1][6].append(r[6])
        else:
            out.append((*r[:6], [r[6]]))
    return [(*r[:6], np.concatenate(r[6])) for r in out]


def fetch(spark: SparkSession, root: str, picks: DataFrame, before: float, after: float) -> DataFrame:
    """(pick, channel, start, rate, data): the samples of each pick's instrument around its time.

    picks: (pick, network, station, location, prefix, at); channels begin with the prefix.
    Segments that a window cuts are trimmed to it; a pick without data has no row.
    """
    timed = picks.withColumns({"t0": F.unix_micros(F.col("at").cast("timestamp")) / 1e6 - before, "t1": F.unix_micros(F.col("at").cast("timestamp")) / 1e6 + after})
    days = timed.withColumn("day", F.explode(F.sequence(F.floor(F.col("t0") / 86400), F.floor(F.col("t1") / 86400)))).withColumn("date", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")))
    dealt = days.withColumn("d", F.dayofyear("date")).withColumn("y", F.year("date")).select("pick", "network", "station", "location", "prefix", "y", "d", "t0", "t1")
    where = root.rstrip("/") if ":/" in root else os.path.abspath(root)
    dealt = dealt.repartition("network", "station", "y", "d").sortWithinPartitions("network", "station", "y", "d")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = files.FileSystem.from_uri(where)

        @lru_cache(_KEPT)
        def channels(folder: str) -> list[str]:
            found = system.get_file_info(files.FileSelector(folder, allow_not_found=True))
            return sorted(x.base_name[:-2] for x in found if x.type == files.FileType.Directory and x.base_name.endswith(".D"))

        @lru_cache(_KEPT)
        def day_file(path: str) -> DayFile | None:
            return DayFile(system.open_input_file(path)) if system.get_file_info(path).type == files.FileType.File else None

        for pdf in batches:
            rows = []
            for w in pdf.itertuples(index=False):
                folder = f"{base}/{w.y}/{w.network}/{w.station}"
                for name in channels(folder):
                    if not name.startswith(w.prefix):
                        continue
                    opened = day_file(f"{folder}/{name}.D/{w.network}.{w.station}.{w.location}.{name}.D.{w.y}.{w.d:03d}")
                    for *_, channel, start, rate, data in segments(opened.between(w.t0, w.t1)) if opened else ():
                        lo = max(0, int(np.ceil((w.t0 - start) * rate - 1e-6)))
                        hi = min(len(data), int(np.floor((w.t1 - start) * rate + 1e-6)) + 1)
                        if lo < hi:
                            rows.append((w.pick, channel, start + lo / rate, rate, data[lo:hi].tolist()))
            yield pd.DataFrame(rows, columns=["pick", "channel", "start", "rate", "data"])

    # Without a location code the files' part is empty; picks without a station have no file.
    known = dealt.filter("network is not null and station is not null and prefix is not null").fillna("", ["location"])
    return known.mapInPandas(run, f"pick {dict(picks.dtypes)['pick']}, channel string, start double, rate double, data array<double>")
