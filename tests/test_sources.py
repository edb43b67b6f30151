"""Containers, manifests, the XML catalog, headerless files and image sinks."""

import struct

import numpy as np
import pytest

from rastrel.sinks import images
from rastrel.sources import containers as C
from rastrel.sources import files, manifest


def short(v, e="<"):
    return struct.pack(e + "H", v)


@pytest.mark.parametrize("big", [False, True])
def test_tiff_chain(big):
    e = ">" if big else "<"
    data = C.written_tiff([[(256, 3, 1, short(7, e)), (271, 2, 6, b"Maker\0")], [(256, 3, 1, short(8, e)), (256, 3, 1, short(9, e))]], big)
    root = C.tiff(data)
    assert [[(x.tag, C.number(x.value, 0, 2, big)) for x in d.last_wins() if x.kind == 3] for d in root.children] == [[(256, 7)], [(256, 9)]]
    assert root.children[0].entries[1].value == b"Maker\0"


def test_a_damaged_chain_keeps_its_beginning():
    data = bytearray(C.written_tiff([[(256, 3, 1, short(7))], [(256, 3, 1, short(8))]]))
    second = struct.unpack_from("<I", data, 8 + 2 + 12)[0]
    struct.pack_into("<H", data, second + 2 + 2, 99)
    assert len(C.tiff(bytes(data)).children) == 1
    struct.pack_into("<H", data, 8 + 2 + 2, 99)
    with pytest.raises(C.ContainerError):
        C.tiff(bytes(data))


def test_loops_end():
    data = bytearray(C.written_tiff([[(256, 3, 1, short(7))], [(256, 3, 1, short(8))]]))
    second = struct.unpack_from("<I", data, 8 + 2 + 12)[0]
    struct.pack_into("<I", data, second + 2 + 12, 8)
    assert len(C.tiff(bytes(data)).children) == 2


def test_sub_directories_and_notes():
    note = b"OLYMPUS\0II\x03\0" + struct.pack("<H", 1) + struct.pack("<HHI", 0x100, 3, 1) + short(5) + b"\0\0" + struct.pack("<I", 0)
    at = 8 + 2 + 2 * 12 + 4
    sub = struct.pack("<H", 1) + struct.pack("<HHI", 257, 3, 1) + short(6) + b"\0\0" + struct.pack("<I", 0)
    head = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 330, 4, 1, at) + struct.pack("<HHII", 37500, 7, len(note), at + len(sub)) + struct.pack("<I", 0)
    d = C.tiff(head + sub + note).children[0]
    assert [c.entries[0].tag for c in d.children] == [257, 0x100] and not d.entries
    assert C.tiff(head[:-4] + struct.pack("<I", 0) + sub[:-4] + b"\xff\xff\xff\xff" + note[:12] + b"\xff\xff").children


def ciff_file(entries, values):
    body = values + struct.pack("<H", len(entries)) + b"".join(entries)
    return b"II" + struct.pack("<I", 14) + b"HEAPCCDR" + body + struct.pack("<I", len(values))


def test_ciff():
    stored = struct.pack("<HII", 0x080A, 6, 0)
    inline = struct.pack("<H", 0x4000 | 0x1834) + b"12345678"
    d = C.ciff(ciff_file([stored, inline], b"Canon\0"))
    assert [(e.tag, e.value) for e in d.entries] == [(0x080A, b"Canon\0"), (0x1834, b"12345678")]
    with pytest.raises(C.ContainerError):
        C.ciff(ciff_file([stored, struct.pack("<HII", 0x0805, 3, 2)], b"Canon\0"), kept=None)
    with pytest.raises(C.ContainerError):
        C.ciff(b"MM" + bytes(40))


def test_fiff_and_mrw():
    t = C.written_tiff([[(271, 2, 9, b"FUJIFILM\0")]])
    head = bytearray(b"FUJIFILMCCD-RAW ".ljust(0x80, b"\0"))
    third = 0x80 + len(t) + 12
    struct.pack_into(">I", head, 0x54, 0x80)
    struct.pack_into(">I", head, 0x5C, third)
    short_list = struct.pack(">I", 1) + struct.pack(">HH", 0x100, 4) + struct.pack(">HH", 30, 40)
    struct.pack_into(">I", head, 0x64, third + len(short_list))
    root = C.fiff(bytes(head) + bytes(12) + t + short_list + b"raw data")
    assert [(e.tag, e.count) for e in root.children[-1].entries] == [(C.FUJI_OFFSETS, 1), (C.FUJI_COUNTS, 1), (0x100, 2)]
    prd = bytes(8) + struct.pack(">HHHHBBBB", 2, 4, 2, 4, 12, 12, 0x59, 0) + bytes(4)
    blocks = struct.pack(">II", 0x505244, len(prd)) + prd + struct.pack(">II", 0x574247, 12) + bytes(4) + struct.pack(">4H", 1, 2, 3, 4)
    m = C.mrw(b"\0MRM" + struct.pack(">I", len(blocks)) + blocks + bytes(12))
    assert (m["width"], m["height"], m["bits"], m["wb"], m["offset"], m["size"]) == (4, 2, 12, [1, 2, 3, 4], 8 + len(blocks), 12)
    with pytest.raises(C.ContainerError):
        C.mrw(b"\0MRM" + struct.pack(">I", 8) + struct.pack(">II", 5, 0))


def test_tables_of_files(spark):
    rows = [(1, C.written_tiff([[(256, 3, 1, short(7))]])), (2, b"nothing"), (3, None)]
    out = {r.file_id: r for r in C.entries(spark.createDataFrame(rows, "file_id long, content binary")).collect()}
    assert out[1].tag == 256 and out[2].error and out[3].error


def test_read_files_and_manifest(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(b"1234")
    (tmp_path / "b.raw").write_bytes(b"")
    out = {r.path.rpartition("/")[2]: r for r in files.read_files(spark, str(tmp_path), "*.raw").collect()}
    assert bytes(out["a.raw"].content) == b"1234" and out["a.raw"].error is None and "b.raw" not in out
    (tmp_path / "filelist.sha1").write_text("0" * 40 + "  x/y.raw\n" + "0" * 40 + " \n")
    m = manifest.read_manifest(spark, str(tmp_path)).collect()
    assert [(r.name, r.full_name, r.error) for r in m] == [("x/y.raw", f"{tmp_path}/x/y.raw", None), (None, None, "line too short")]


CATALOG = """<Cameras>
<Camera make="Acme" model="One"><ID make="ACME" model="1">Acme One</ID><CFA2 width="2" height="2"><ColorRow y="0">RG</ColorRow><ColorRow y="1">GB</ColorRow></CFA2>
<Crop x="1" y="2" width="-3" height="0"/><Sensor black="10" white="4000"/><Aliases><Alias id="Uno">One-J</Alias><Alias>One-K</Alias></Aliases>
<Hints><Hint name="filesize" value="1000"/><Hint name="filesize" value="2000"/><Hint name="full_width" value="10"/><Hint name="full_height" value="20"/><Hint name="order" value="jpeg16"/></Hints></Camera>
<Camera make="Acme" model="Two" mode="dng" supported="no" decoder_version="3"><Sensor black="1" white="2" iso_min="100"/><Sensor black="3" white="4" iso_list="1 2"/></Camera></Cameras>"""


def test_catalog(spark, tmp_path):
    path = tmp_path / "cameras.xml"
    path.write_text(CATALOG)
    cams = files.read_catalog(spark, str(path)).orderBy("model").collect()
    assert [(c.model, c.canonical_alias, c.canonical_make) for c in cams] == [("One", "One", "ACME"), ("One-J", "Uno", "ACME"), ("One-K", "One-K", "ACME"), ("Two", "Two", "Acme")]
    assert cams[0].hints["filesize"] == "1000" and cams[0]["mode"] == "" and cams[3]["mode"] == "dng" and len(cams[3].sensors) == 2
    sizes = spark.createDataFrame([("f", 1000), ("g", 5)], "path string, length long")
    got = files.headerless(sizes, files.read_catalog(spark, str(path)).filter("alias_no = 0")).collect()
    assert [(r.path, r.width, r.height, r.bits, r.order) for r in got] == [("f", 10, 20, 40, "msb16")]


def test_images(spark, tmp_path):
    img = np.arange(12).reshape(3, 4) * 1000
    assert images.pixmap(img) == b"P5\n4 3\n65535\n" + img.astype(">u2").tobytes()
    f = images.float_map(img / 7)
    at = len(f) - 48
    assert at % 16 == 0 and np.frombuffer(f, "<f4", offset=at).reshape(3, 4)[::-1].astype("f4").tolist() == (img / 7).astype("f4").tolist()
    rows = [(5, y, x, int(img[y, x])) for y in range(3) for x in range(4)]
    out = images.write_images(spark.createDataFrame(rows, "image_id long, y int, x int, v long"), f"file://{tmp_path}/out", 4, 3).collect()
    assert (tmp_path / "out" / "5.ppm").read_bytes() == images.pixmap(img) and out[0].bytes == len(images.pixmap(img))


def test_the_choice_of_a_decoder_decides_about_samples(spark):
    """Plain images with a white level: one that says DNG, one of a maker whose decoder doesn't know that tag, one of a maker that has no decoder, and one that names nobody."""
    from rastrel.operators import decode

    def plain(*more):
        words = lambda base: [(256, 3, 1, short(2)), (257, 3, 1, short(1)), (258, 3, 1, short(16)), *[m for m in more if m[0] < 273], (273, 4, 1, struct.pack("<I", base)), (279, 4, 1, struct.pack("<I", 4)), *[m for m in more if m[0] > 279], (50717, 3, 1, short(14))]
        return C.written_tiff([words(len(C.written_tiff([words(0)])))]) + short(7) + short(65535)

    made = [(1, plain((50706, 4, 1, b"\x01\x01\0\0"))), (2, plain((271, 2, 6, b"Canon\0"))), (3, plain((271, 2, 5, b"Acme\0"))), (4, plain())]
    images, samples = decode.decode(spark.createDataFrame(made, "file_id long, content binary"))
    assert {r.file_id: (r.decoder, r.error) for r in images.collect()} == {1: ("DNG", None), 2: ("CR2", None), 3: (None, "no decoder"), 4: (None, "no decoder")}
    assert sorted((r.file_id, r.v) for r in samples.collect()) == [(1, 32767), (1, 65535), (2, 7), (2, 65535)]


def test_a_catalog_is_written_in_files_of_bounded_size(spark, monkeypatch):
    """One task reads one XML file, so files don't grow with the catalog."""
    from rastrel.plans import storage

    monkeypatch.setattr(storage, "CATALOG_ROWS", 50)
    got = storage.src03_catalog(spark, "/root/testdata/sf0.001")
    assert got.count() == 200 and len(got.inputFiles()) >= 4
