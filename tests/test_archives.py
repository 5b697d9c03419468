from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F


def tar_bytes(members, mode="w"):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode=mode) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return raw.getvalue()


MEMBERS = [("d/1.json", b"{}"), ("d/1.wav", b"abc" * 700), ("d/2.json", b"[]"), ("x" * 150 + ".wav", b"long name")]


def test_members_by_byte_range(spark, tmp_path):
    from talweg.sources import archives as A

    (tmp_path / "a.tar").write_bytes(tar_bytes(MEMBERS))
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("e")
        z.writestr("e/3.wav", b"zip" * 900)
        z.writestr("e/4.txt", b"", zipfile.ZIP_STORED)
    (tmp_path / "c.bin").write_bytes(b"not an archive at all" * 60)
    (tmp_path / "d.tgz").write_bytes(gzip.compress(tar_bytes(MEMBERS)))
    (tmp_path / "e.zip").write_bytes((tmp_path / "b.zip").read_bytes()[:-30])
    found = A.archives(spark, str(tmp_path))
    assert found.count() == 5
    index = A.member_index(found).cache()
    name = F.substring_index("archive", "/", -1)
    rows = {(r["a"], r["member"]): r for r in index.select("*", name.alias("a")).collect()}
    assert {k for k in rows if k[0] == "a.tar"} == {("a.tar", n) for n, _ in MEMBERS} and rows["b.zip", "e/3.wav"]["size"] == 2700
    assert rows["c.bin", None]["fault"].startswith("unreadable") and rows["e.zip", None]["fault"].startswith("unreadable") and "stream" in rows["d.tgz", None]["fault"]
    got = {(r["a"], r["member"]): r for r in A.member_contents(index, tasks=3).select("*", name.alias("a")).collect()}
    assert {(a, m): bytes(r["content"]) for (a, m), r in got.items() if a == "a.tar"} == {("a.tar", n): d for n, d in MEMBERS}
    assert bytes(got["b.zip", "e/3.wav"]["content"]) == b"zip" * 900 and bytes(got["b.zip", "e/4.txt"]["content"]) == b""
    assert {r["member"] for r in A.member_contents(index, [".WAV"]).collect()} == {"d/1.wav", "x" * 150 + ".wav", "e/3.wav"}
    assert A.member_contents(index, [".wav"], most=100).where("fault = 'too large'").count() == 2
    pairs = {(r["stem"], r["complete"]) for r in A.paired_members(index.where("member IS NOT NULL")).collect()}
    assert {("d/1", True), ("d/2", False), ("e/3", False)} <= pairs
    # a damaged member is a fault of its own
    raw = bytearray((tmp_path / "b.zip").read_bytes())
    raw[75] ^= 0xFF
    (tmp_path / "bad.zip").write_bytes(raw)
    bad = A.member_contents(A.member_index(A.archives(spark, str(tmp_path), "bad.zip")))
    assert {r["member"]: r["fault"] for r in bad.collect()}["e/3.wav"] in ("damaged", "checksum", "truncated")


def test_an_archive_of_more_than_two_gigabytes(spark, tmp_path):
    from talweg.sources import archives as A

    with open(tmp_path / "big.tar", "wb") as f:  # a hole in the middle: few blocks on disk
        for name, size in (("a.txt", 5), ("hole.bin", 2_300_000_000), ("z.txt", 7)):
            info = tarfile.TarInfo(name)
            info.size = size
            f.write(info.tobuf(tarfile.GNU_FORMAT))
            if size < 10:
                f.write(b"7" * size)
                f.write(b"\0" * (-size % 512))
            else:
                f.seek((size + 511) // 512 * 512, 1)
        f.write(b"\0" * 1024)
    index = A.member_index(A.archives(spark, str(tmp_path)))
    got = {r["member"]: (r["content"] and bytes(r["content"]), r["fault"]) for r in A.member_contents(index).collect()}
    assert got == {"a.txt": (b"7" * 5, None), "hole.bin": (None, "too large"), "z.txt": (b"7" * 7, None)}
    assert {r["member"]: r["size"] for r in index.collect()}["hole.bin"] == 2_300_000_000


def test_membership_and_collection_faults(spark, tmp_path):
    from talweg.sources import archives as A

    (tmp_path / "a.tar").write_bytes(tar_bytes([("ok/1.wav", b"x"), ("../up.wav", b"x"), ("ok/2.exe", b"x"), ("ok/3.wav", b""), ("ok/1.wav", b"y"), ("/abs.wav", b"x"), ("a\\b.wav", b"x")]))
    found = A.archives(spark, str(tmp_path))
    faults = {(r["member"], r["fault"]) for r in A.membership_faults(A.member_index(found), r"ok/\d\.wav").collect()}
    assert {("ok/1.wav", "repeated"), ("../up.wav", "unsafe name"), ("ok/2.exe", "not allowed"), ("ok/3.wav", "empty"), ("/abs.wav", "unsafe name"), ("a\\b.wav", "unsafe name")} <= faults
    assert not any(m == "ok/1.wav" and f != "repeated" for m, f in faults)
    size = (tmp_path / "a.tar").stat().st_size
    catalog = lambda *rows: spark.createDataFrame(list(rows), "name string, bytes long")
    assert A.collection_faults(found, catalog(("a.tar", size))).count() == 0
    got = {(r["name"], r["fault"]) for r in A.collection_faults(found, catalog(("a.tar", size + 1), ("b.tar", 3))).collect()}
    assert got == {("a.tar", "size differs"), ("b.tar", "missing")}
    assert [tuple(r) for r in A.collection_faults(found, catalog(("c.tar", 1))).orderBy("name").collect()] == [("a.tar", "unlisted"), ("c.tar", "missing")]


def test_submissions(spark):
    from talweg.sources import archives as A

    prompts = "s1/mfc/u1  Первый текст \r\n*/u2\tвторой\n\nlonely\ns1/u4 нет записи\ns1/u5 раз\ns1/u5 два\n"
    data = [("z", "root/s1/etc/PROMPTS", prompts.encode())] + [("z", f"root/s1/wav/{u}.wav", b"w") for u in ("u1", "u2", "u3", "u5")] + [("z", "root/s2/wav/u1.wav", b"w"), ("z", "root/s1/LICENSE", b"l")]
    got = {(r["submission"], r["utterance"]): (r["text"], r["fault"]) for r in A.submission_prompts(spark.createDataFrame(data, "archive string, member string, content binary")).collect()}
    assert got["s1", "u1"] == ("Первый текст", None) and got["s1", "u2"] == ("второй", None)
    assert got["s1", "u3"] == (None, "no prompt") and got["s1", "u4"][1] == "no recording" and got["s1", "u5"][1] == "repeated" and got["s1", ""][1] == "malformed" and got["s2", "u1"][1] == "no prompt"


def test_streams_are_hashed_whole(spark, tmp_path):
    from talweg.sources import archives as A

    data = gzip.compress(tar_bytes([(f"{i}.{'txt' if i % 2 else 'bin'}", bytes([i]) * 30_000 * i) for i in range(6)]) + b"\0" * 5000, 1)
    cuts = [0, 10, 700, len(data) - 3, len(data)]
    parts = []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        (tmp_path / f"p{i}").write_bytes(data[a:b])
        parts.append(f"{tmp_path}/p{i}")
    (tmp_path / "cut").write_bytes(data[:-9])
    rows = A.read_tar_stream(spark, [parts, f"{tmp_path}/cut"], [".txt"]).collect()
    whole, cut = ([r for r in rows if r["archive"] == a] for a in (parts[0], f"{tmp_path}/cut"))
    members = [r for r in whole if r["kind"] == "member"]
    assert [(r["number"], r["name"], r["size"]) for r in members] == [(i, f"{i}.{'txt' if i % 2 else 'bin'}", 30_000 * i) for i in range(6)]
    assert all(r["sha256"] == hashlib.sha256(bytes([i]) * 30_000 * i).hexdigest() for i, r in enumerate(members))
    assert [r["content"] is not None for r in members] == [i % 2 == 1 for i in range(6)]
    assert [(r["name"], r["size"], r["sha256"]) for r in whole if r["kind"] == "part"] == [(p, b - a, hashlib.sha256(data[a:b]).hexdigest()) for p, a, b in zip(parts, cuts, cuts[1:], strict=False)]
    last = whole[-1]
    assert (last["kind"], last["size"], last["sha256"], last["read_bytes"], last["fault"]) == ("archive", len(data), hashlib.sha256(data).hexdigest(), len(data), None)
    assert cut[-1]["kind"] == "archive" and cut[-1]["fault"].startswith("unreadable") and not [r for r in cut if r["kind"] == "part"]


def test_written_tars_read_back(spark, tmp_path):
    from talweg.sources import archives as A

    df = spark.createDataFrame([(f"{i:03d}/{'n' * (i % 120)}.txt", bytes([i % 256]) * i) for i in range(300)] + [("null.txt", None)], "member string, content binary").repartition(3)
    plain = A.write_tars(df, f"{tmp_path}/plain")
    back = A.member_contents(A.member_index(plain.select(F.explode("parts").alias("archive"))))
    want = {r["member"]: bytes(r["content"] or b"") for r in df.collect()}
    assert {r["member"]: bytes(r["content"]) for r in back.collect()} == want
    packed = A.write_tars(df, f"{tmp_path}/packed", compressed=True, part_bytes=1000)
    parts = [r["parts"] for r in packed.collect()]
    assert max(map(len, parts)) > 1
    rows = A.read_tar_stream(spark, parts, [".txt"]).where("kind = 'member'").collect()
    assert {r["name"]: bytes(r["content"]) for r in rows} == want
    assert A.write_tars(df.limit(0), f"{tmp_path}/none").count() == 0
