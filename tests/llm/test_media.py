"""Images, archives and their data source."""

import glob
import zipfile

from codelode.llm.common import fresh_path
from codelode.llm.media import describe_media, from_png, read_media, read_member, to_png, write_media

ROWS = [(1, "hello"), (2, ""), (3, None), (4, "é" * 5000), (4, "again"), (None, "null id"), (5, "x" * 576)]


def test_png_round_trip():
    for _, text in ROWS:
        data = (text or "").encode()
        size, payload = from_png(to_png(text))
        assert size == len(data) and payload[: len(data)] == data
        assert len(payload) % 576 == 0 and len(payload) >= 576 and set(payload[len(data):]) <= {255}


def test_archives(spark):
    folder = fresh_path(spark, "media")
    write_media(spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2), folder)
    got = describe_media(read_media(spark, folder, range_bytes=700)).collect()
    assert sorted(str((r.doc_id, r.n_bytes)) for r in got) == sorted(str((i, len((t or "").encode()))) for i, t in ROWS)
    assert all(r.error is None for r in got)
    # Damage one member: its row has the error, the others are whole.
    path = max(glob.glob(folder.removeprefix("file://") + "/*.zip"), key=lambda p: len(zipfile.ZipFile(p).infolist()))
    with zipfile.ZipFile(path) as archive:
        first = archive.infolist()[0]
    data = bytearray(open(path, "rb").read())
    data[first.header_offset + 60] ^= 255
    open(path, "wb").write(data)
    again = describe_media(read_media(spark, folder)).collect()
    assert len(again) == len(ROWS) and sum(r.error is not None for r in again) == 1


def test_a_member_is_tried_again_by_its_offset(tmp_path):
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("0/1.png", b"one")
    tries = []

    class Flaky(zipfile.ZipFile):
        def read(self, *args):
            raise OSError("lost")

    def reopen():
        tries.append(1)
        if len(tries) < 2:
            raise OSError("still lost")
        return open(path, "rb")

    with Flaky(path) as archive:
        assert read_member(reopen, archive, archive.infolist()[0]) == (b"one", None)
    with Flaky(path) as archive:
        media, error = read_member(lambda: (_ for _ in ()).throw(OSError("gone")), archive, archive.infolist()[0])
    assert media is None and "gone" in error


def test_empty(spark):
    folder = fresh_path(spark, "media")
    write_media(spark.createDataFrame([], "doc_id long, text string"), folder)
    assert read_media(spark, folder).count() == 0
