"""The archive reader on day files written here."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fastaxis.sources import archive


def record(cha, second, payload, count, encoding, rate=100, order=">"):
    head = b"000001D " + b"ATH  " + b"  " + cha.encode() + b"HL" + struct.pack(f"{order}HHBBBBHHhh", 2026, 32, 0, second // 60, second % 60, 0, 0, count, rate, 1)
    head += struct.pack(f"{order}BBBBiHH", 0, 0, 0, 1, 0, 64, 48)
    blockette = struct.pack(f"{order}HHBBBB", 1000, 0, encoding, int(order == ">"), 12, 0)
    return (head + blockette + bytes(8) + payload).ljust(4096, b"\0")


def steim1(x, second=False, order=">"):
    """Frames with every difference in 32 (or 30) bits, but for the small ones, four or two in a word; bytes and pairs in stored order."""
    d = np.concatenate([[0], np.diff(x)]).astype(int).tolist()
    words, codes = [int(x[0]), int(x[-1])], [0, 0]
    while d:
        if len(d) >= 4 and all(-128 <= v < 128 for v in d[:4]):
            words.append(struct.unpack(f"{order}I", struct.pack("4b", *d[:4]))[0])
            codes.append(1)
            d = d[4:]
        elif not second and len(d) >= 2 and all(-(1 << 15) <= v < 1 << 15 for v in d[:2]):
            words.append(struct.unpack(f"{order}I", struct.pack(f"{order}2h", *d[:2]))[0])
            codes.append(2)
            d = d[2:]
        elif second and len(d) >= 2 and all(-(1 << 14) <= v < 1 << 14 for v in d[:2]):
            words.append(2 << 30 | (d[0] & 0x7FFF) << 15 | d[1] & 0x7FFF)
            codes.append(2)
            d = d[2:]
        else:
            words.append((1 << 30 | d[0] & 0x3FFFFFFF) if second else d[0])
            codes.append(2 if second else 3)
            d = d[1:]
    out = b""
    for k in range(0, len(words), 15):
        part, own = words[k : k + 15] + [0] * 15, codes[k : k + 15] + [0] * 15
        control = sum(c << (28 - 2 * i) for i, c in enumerate(own[:15]))
        out += struct.pack(f"{order}16I", control, *[w & 0xFFFFFFFF for w in part[:15]])
    return out


@pytest.mark.parametrize("encoding", [1, 3, 4, 5, 10, 11])
@pytest.mark.parametrize("order", [">", "<"])
def test_records(encoding, order):
    rnd = np.random.default_rng(encoding)
    x = np.cumsum(rnd.integers(-300, 300, 200))
    x[50:100] = x[50] + np.arange(50)
    if encoding >= 10:
        x[150] += 100_000  # beyond two bytes
        payload = steim1(x, encoding == 11, order)
    else:
        payload = x.astype(order + {1: "i2", 3: "i4", 4: "f4", 5: "f8"}[encoding]).tobytes()
    (got,) = archive.records(record("HHZ", 5, payload, 200, encoding, order=order))
    assert got[:4] == ("HL", "ATH", "", "HHZ") and got[5] == 100.0 and got[6].tolist() == x.tolist()
    assert got[4] == 1769904000 + 5


def test_fetch(spark, tmp_path):
    folder = tmp_path / "2026/HL/ATH"
    for cha in ("HHZ", "HHN", "BHE"):
        (folder / f"{cha}.D").mkdir(parents=True)
        parts = [record(cha, 2 * k, np.arange(200 * k, 200 * k + 200).astype(">i4").tobytes(), 200, 3) for k in (0, 1, 2, 4)]
        (folder / f"{cha}.D/HL.ATH..{cha}.D.2026.032").write_bytes(b"".join(parts))
    picks = spark.createDataFrame([("p", "HL", "ATH", "", "HH", "2026-02-01 00:00:03"), ("q", "HL", "ATH", "", "HH", "2025-02-01 00:00:03"), ("r", "HL", "ATH", "", "HH", "2026-02-01 00:00:07.2")], "pick string, network string, station string, location string, prefix string, at string").withColumn("at", F.col("at").cast("timestamp"))
    rows = {(r.pick, r.channel): r for r in archive.fetch(spark, f"file://{tmp_path}", picks, 1.0, 0.5).collect()}
    assert set(rows) == {("p", "HHZ"), ("p", "HHN")}  # r lies in a gap
    assert rows["p", "HHZ"].data == [float(v) for v in range(200, 351)] and rows["p", "HHZ"].start == 1769904002
    assert archive.fetch(spark, f"file://{tmp_path}", picks.filter("pick = 'q'"), 1.0, 0.5).count() == 0
    assert archive.fetch(spark, f"{tmp_path}/", picks, 1.0, 0.5).count() == 2


def test_day_file_reads_what_a_window_touches(tmp_path):
    """Records of two lengths in no order: the index has all of them, samples are read of one record only."""
    parts = [record("HHZ", 2 * k, np.arange(200 * k, 200 * k + 200).astype(">i4").tobytes(), 200, 3) for k in range(600)]
    mixed = [*parts[300:], *parts[:300]]
    (tmp_path / "day").write_bytes(b"".join(mixed) + b"no record")
    from pyarrow import fs

    opened = archive.DayFile(fs.LocalFileSystem().open_input_file(str(tmp_path / "day")))
    assert [at for at, _ in opened.index] == [4096 * k for k in range(600)]
    start = 1769904000
    (got,) = archive.segments(opened.between(start + 100.5, start + 101.5))
    assert got[6].tolist() == list(range(50 * 200, 51 * 200)) and opened.taken == 4096
    (joined,) = archive.segments(opened.between(start + 597.5, start + 602.5))
    assert joined[6].tolist() == list(range(298 * 200, 302 * 200)) and opened.taken == 5 * 4096


def test_nothing_runs_on_the_driver(spark, tmp_path):
    """The plan alone starts no job, and an archive that isn't there has no rows."""
    picks = spark.createDataFrame([("p", "HL", "ATH", None, "HH", "2026-02-01 00:00:03"), ("q", None, "ATH", "", "HH", "2026-02-01 00:00:03")], "pick string, network string, station string, location string, prefix string, at string")
    spark.sparkContext.setJobGroup("archive-plan", "")
    wanted = archive.fetch(spark, f"file://{tmp_path}/none", picks, 1.0, 0.5)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("archive-plan")
    assert wanted.count() == 0
