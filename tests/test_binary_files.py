"""Binary files of a single-process store: files made here by hand are read back."""

import struct
import zlib

import pytest

from tidelog.operators.resolve import snapshot
from tidelog.sources import binary_files

ROWS = [("a", "one", 5, False), ("b", "", 6, False), ("c", None, 7, True), ("č", "x" * 300, 8, False)]


def uvarint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def checked(body):
    return struct.pack("<I", zlib.crc32(body)) + body


def stamp(ts):
    return struct.pack("<Q8x", ts)


def plain(key, value, ts, gone):
    k, v = key.encode(), (value or "").encode()
    return checked(stamp(ts) + bytes([gone]) + struct.pack("<QQ", len(k), len(v)) + k + v)


def packed(key_id, value, ts, gone):
    v = (value or "").encode()
    return checked(stamp(ts) + bytes([gone]) + uvarint(key_id) + (b"" if gone else uvarint(len(v)) + v))


def one_file(data):
    ends = [48, *(48 + len(data) + k for k in (0, 3, 6, 9, 12))]
    return struct.pack("<6Q", *ends) + data + b"xyz" * 4


def tuples(df):
    return sorted((r["key"], r["value"], r["ts"], r["tombstone"]) for r in df.collect())


@pytest.mark.parametrize("single", [True, False])
def test_runs(spark, tmp_path, single):
    folder = tmp_path / "sstable" / "1-sstable"
    folder.mkdir(parents=True)
    data = b"".join(plain(*r) for r in ROWS)
    if single:
        (folder / "1.db").write_bytes(one_file(data))
    else:
        (folder / "1-Data.db").write_bytes(data + bytes(77))
        (folder / "1-Index.db").write_bytes(b"no records")
    found = binary_files.read_runs(spark, str(tmp_path / "sstable"), single)
    assert tuples(found) == sorted(ROWS)
    assert {r["key"]: r["value"] for r in snapshot(found).collect()} == {r[0]: r[1] for r in ROWS if not r[3]}


def test_broken_records_are_left_out(spark, tmp_path):
    broken = bytearray(b"".join(plain(*r) for r in ROWS))
    broken[len(plain(*ROWS[0])) - 1] ^= 1
    (tmp_path / "1.db").write_bytes(one_file(bytes(broken)))
    (tmp_path / "2.db").write_bytes(one_file(plain(*ROWS[1]))[:60])
    assert [r[0] for r in tuples(binary_files.read_runs(spark, str(tmp_path)))] == ["b", "c", "č"]


def test_compressed_runs(spark, tmp_path):
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "1.db").write_bytes(one_file(b"".join(packed(200 + k, *r[1:]) for k, r in enumerate(ROWS))))
    (tmp_path / "dictionary.db").write_bytes(b"".join(uvarint(200 + k) + uvarint(len(r[0].encode())) + r[0].encode() for k, r in enumerate(ROWS)))
    words = binary_files.read_dictionary(spark, str(tmp_path / "dictionary.db"))
    assert {r["id"]: r["key"] for r in words.collect()} == {200 + k: r[0] for k, r in enumerate(ROWS)}
    assert tuples(binary_files.read_runs(spark, str(tmp_path / "runs"), dictionary=words)) == sorted(ROWS)


def fragment(kind, key, value, ts, gone):
    return checked(stamp(ts) + bytes([not gone, kind]) + struct.pack("<QQ", len(key), len(value)) + key + value)


BLOCK = 128


def log_blocks(records):
    """Blocks of a log, each a list of fragments: records fill blocks up and go on in the next ones."""
    blocks, room = [[]], BLOCK - 7
    for key, value, ts, gone in records:
        rest_key, rest_value, begun = key.encode(), (value or "").encode(), False
        while True:
            fits = room - 38
            if fits < 1:
                blocks.append([])
                room = BLOCK if len(blocks) % 3 != 1 else BLOCK - 7
                continue
            k, v = rest_key[:fits], rest_value[: max(0, fits - len(rest_key))]
            rest_key, rest_value = rest_key[len(k) :], rest_value[len(v) :]
            done = not rest_key and not rest_value
            kind = (3 if done else 2) if begun else (0 if done else 1)
            blocks[-1].append(fragment(kind, k, v, ts, gone))
            room -= len(blocks[-1][-1])
            begun = True
            if done:
                break
    return blocks


def write_log(folder, blocks, lost=None):
    """Segments of three blocks; of the fragments the one at place lost is damaged."""
    n = 0
    for number in range(0, len(blocks), 3):
        parts = []
        for k, held in enumerate(blocks[number : number + 3]):
            out = b"WAL" + struct.pack("<I", number // 3) if k == 0 else b""
            for one in held:
                out += one[:-1] + bytes([one[-1] ^ 1]) if n == lost else one
                n += 1
            assert len(out) <= BLOCK
            parts.append(out.ljust(BLOCK, b"\0"))
        (folder / f"wal_{number // 3:04}.log").write_bytes(b"".join(parts))


LOG = [("a", "one", 5, False), ("k1", "x" * 300, 8, False), ("c", None, 7, True), ("k2", "y" * 200, 8, False), ("č", "z" * 1500, 9, False), ("d", "", 10, False), ("k3", "w" * 90, 8, False)]


def test_log(spark, tmp_path):
    write_log(tmp_path, log_blocks(LOG))
    assert len(list(tmp_path.iterdir())) > 4
    assert tuples(binary_files.read_log(spark, str(tmp_path), BLOCK)) == sorted(LOG)


def owners():
    """The record of each fragment, in order."""
    alone = [[f for held in log_blocks(LOG[: k + 1]) for f in held] for k in range(len(LOG))]
    return [k for k, held in enumerate(alone) for _ in range(len(held) - (len(alone[k - 1]) if k else 0))]


def test_each_lost_fragment_loses_its_record_alone(spark, tmp_path):
    blocks, whose = log_blocks(LOG), owners()
    assert len(whose) == sum(map(len, blocks)) > 20
    for lost in (0, 1, 2, len(whose) // 2, len(whose) - 2, len(whose) - 1):
        folder = tmp_path / f"{lost:03}"
        folder.mkdir()
        write_log(folder, blocks, lost)
        assert tuples(binary_files.read_log(spark, str(folder), BLOCK)) == sorted(r for k, r in enumerate(LOG) if k != whose[lost])


def test_a_lost_segment_loses_what_reaches_over_it(spark, tmp_path):
    write_log(tmp_path, log_blocks(LOG))
    (tmp_path / "wal_0002.log").unlink()
    found = tuples(binary_files.read_log(spark, str(tmp_path), BLOCK))
    assert set(found) < set(LOG) and LOG[0] in found and LOG[4] not in found


def test_workers_need_not_share_the_folder(tmp_path):
    """A session that starts elsewhere, with the package on the driver's path alone."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    (tmp_path / "log").mkdir()
    write_log(tmp_path / "log", log_blocks(LOG))
    script = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from tidelog.session import session
from tidelog.sources import binary_files
spark = session("elsewhere", "local[2]", 2)
print("rows", binary_files.read_log(spark, {str(tmp_path / "log")!r}, {BLOCK}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    told = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert f"rows {len(LOG)}" in told.stdout, told.stderr[-2000:]
