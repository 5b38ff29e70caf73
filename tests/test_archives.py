import hashlib
import os
import struct
import zipfile

import pytest

from plumbline.sources import archives, files


@pytest.fixture
def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "a b+c%20d.zip", "w") as z:
        for i in range(40):
            z.writestr(f"dir x/{i}.txt", os.urandom(20_000) if i % 2 else b"text " * 9000, zipfile.ZIP_DEFLATED if i % 3 else zipfile.ZIP_STORED)
        z.writestr("dir x/", b"")
        z.writestr("empty", b"")
        z.writestr("../outside", b"no")
        z.writestr("packed", b"no" * 100, zipfile.ZIP_LZMA)
    (tmp_path / "none.zip").write_bytes(b"this is no archive")
    (tmp_path / "nothing.zip").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "hurt.zip", "w") as z:
        z.writestr("good", b"good content")
        z.writestr("bad", b"bad content" * 50, zipfile.ZIP_DEFLATED)
        z.writestr("gone", b"x" * 10)
        places = {i.filename: i.header_offset for i in z.infolist()}
    raw = bytearray((tmp_path / "hurt.zip").read_bytes())
    at = places["bad"] + 30 + len("bad")
    raw[at + 3] ^= 0xFF
    raw[places["gone"] : places["gone"] + 4] = b"????"
    (tmp_path / "hurt.zip").write_bytes(raw)
    with zipfile.ZipFile(tmp_path / "locked.zip", "w") as z:
        z.writestr("secret", b"abc")
    raw = bytearray((tmp_path / "locked.zip").read_bytes())
    central = raw.rindex(b"PK\x01\x02")
    raw[central + 8 : central + 10] = struct.pack("<H", 1)
    (tmp_path / "locked.zip").write_bytes(raw)
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "sub" / "c.ZIP", "w") as z:
        z.writestr("é/ü.png", b"1")
    return tmp_path


def test_members_are_read_in_parts(spark, folder):
    df = archives.zip_members(spark, str(folder), part_bytes=100_000)
    assert df.rdd.getNumPartitions() > 8
    rows = {(os.path.basename(r.archive), r.member): r for r in df.collect()}
    with zipfile.ZipFile(folder / "a b+c%20d.zip") as z:
        for i in z.infolist():
            if i.filename.startswith("dir x/") and not i.is_dir():
                r = rows["a b+c%20d.zip", i.filename]
                assert r.error is None and r.size == i.file_size and r.sha256 == hashlib.sha256(z.read(i.filename)).hexdigest()
    assert rows["a b+c%20d.zip", "empty"].sha256 == hashlib.sha256(b"").hexdigest()
    assert rows["c.ZIP", "é/ü.png"].sha256 == hashlib.sha256(b"1").hexdigest()


def test_what_cannot_be_read_is_a_row(spark, folder):
    rows = {(os.path.basename(r.archive), r.member): r for r in archives.zip_members(spark, f"file://{folder}").collect()}
    for key, what in (
        (("none.zip", None), ""), (("nothing.zip", None), ""), (("hurt.zip", "bad"), ""), (("hurt.zip", "gone"), "header"),
        (("locked.zip", "secret"), "encrypted"), (("a b+c%20d.zip", "../outside"), "leads out"), (("a b+c%20d.zip", "packed"), "method 14"),
    ):
        assert rows[key].error is not None and what in rows[key].error and rows[key].sha256 is None
    assert rows["hurt.zip", "good"].sha256 == hashlib.sha256(b"good content").hexdigest()


def test_one_archive_and_none(spark, folder, tmp_path):
    assert archives.zip_members(spark, str(folder / "sub" / "c.ZIP")).count() == 1
    (tmp_path / "bare").mkdir()
    assert archives.zip_members(spark, str(tmp_path / "bare")).count() == 0
    with pytest.raises(Exception, match="does not exist"):
        archives.zip_members(spark, str(tmp_path / "missing")).count()


def test_listing_of_archives_goes_on(spark, folder):
    rows = files.archive_members(spark, str(folder)).collect()
    assert {os.path.basename(r.archive) for r in rows if r.error} == {"none.zip"}
    assert sum(r.error is None for r in rows) > 45
