"""Files through the whole engine: fixtures are written here."""

import json
import os
import struct
import zlib

import numpy as np
import pytest

from veriframe import __main__ as cli
from veriframe import api
from veriframe.functions import schema as S
from veriframe.functions.exif import read_exif
from veriframe.operators import features as X
from veriframe.operators import model as M
from veriframe.sources import images as I
from veriframe.streaming import images as stream


def png(a: np.ndarray, extra: bytes = b"") -> bytes:
    """``a``: height x width (gray), or with 3 or 4 channels, red first."""
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    kind = {1: 0, 3: 2, 4: 6}[a.shape[2] if a.ndim == 3 else 1]
    body = b"".join(b"\0" + row.tobytes() for row in a)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, kind, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def tiff(order: str = "<") -> bytes:
    """Make, Software, Orientation 6, an Exif directory with FNumber, a GPS directory."""
    e = order
    head = (b"II*\0" if e == "<" else b"MM\0*") + struct.pack(e + "I", 8)
    entry = lambda tag, kind, n, v: struct.pack(e + "HHI", tag, kind, n) + v
    base = 8 + 2 + 12 * 5 + 4
    ifd = struct.pack(e + "H", 5) + entry(0x010F, 2, 6, struct.pack(e + "I", base)) + entry(0x0112, 3, 1, struct.pack(e + "HH", 6, 0)) + entry(0x0131, 2, 4, b"abc\0") + entry(0x8769, 4, 1, struct.pack(e + "I", base + 6)) + entry(0x8825, 4, 1, struct.pack(e + "I", base + 6 + 26)) + b"\0" * 4
    sub = struct.pack(e + "H", 1) + entry(0x829D, 5, 1, struct.pack(e + "I", base + 6 + 18)) + b"\0" * 4 + struct.pack(e + "II", 28, 10)
    gps = struct.pack(e + "H", 1) + entry(1, 2, 2, b"N\0\0\0") + b"\0" * 4
    return head + ifd + b"Canon\0" + sub + gps


def jpeg_bytes(spark, a: np.ndarray) -> bytes:
    jvm = spark._jvm
    im = jvm.java.awt.image.BufferedImage(a.shape[1], a.shape[0], 1)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            im.setRGB(x, y, int(a[y, x, 0]) << 16 | int(a[y, x, 1]) << 8 | int(a[y, x, 2]))
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(im, "jpg", out)
    return bytes(out.toByteArray())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(1)
    (d / "a.png").write_bytes(png(rng.integers(0, 256, (40, 50, 3), dtype=np.uint8)))
    (d / "B.PNG").write_bytes(png(rng.integers(0, 256, (30, 30), dtype=np.uint8)))
    (d / "c.png").write_bytes(png(rng.integers(0, 256, (20, 20, 4), dtype=np.uint8)))
    j = jpeg_bytes(spark, rng.integers(0, 256, (24, 33, 3), dtype=np.uint8))
    app = b"Exif\0\0" + tiff()
    (d / "d.jpg").write_bytes(j[:2] + b"\xff\xe1" + struct.pack(">H", len(app) + 2) + app + j[2:])
    (d / "broken.jpg").write_bytes(b"not an image")
    (d / "empty.jpeg").write_bytes(b"")
    (d / "e.webp").write_bytes(b"RIFF....WEBP")
    (d / "notes.txt").write_text("x")
    return str(d)


def test_exif_in_both_byte_orders_and_broken_input():
    for order in "<>":
        tags, gps, turn = read_exif(tiff(order))
        assert tags["Make"] == "Canon" and tags["FNumber"] == "2.8" and tags["Software"] == "abc" and "GPSInfo" in tags and gps == {"GPSLatitudeRef": "N"} and turn == 6
    assert read_exif(None) == ({}, {}, 1) == read_exif(tiff()[:20]) == read_exif(b"\xff\xd8\xff\xe1")


def test_orientation_turns_pixels():
    a = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    turned = {t: X.pixels(a.tobytes(), 2, 3, 3, t) for t in range(1, 9)}
    assert np.array_equal(turned[1], a) and np.array_equal(turned[2], a[:, ::-1]) and np.array_equal(turned[3], a[::-1, ::-1]) and np.array_equal(turned[4], a[::-1])
    assert np.array_equal(turned[5], a.swapaxes(0, 1)) and np.array_equal(turned[6], np.rot90(a, -1)) and np.array_equal(turned[8], np.rot90(a)) and np.array_equal(turned[7], a[::-1, ::-1].swapaxes(0, 1))


def test_scan_classify_and_summary(spark, folder):
    scanned = {os.path.basename(r.path): r for r in I.scan_images(spark, folder).collect()}
    assert "notes.txt" not in scanned and scanned["broken.jpg"].status == "undecodable" and scanned["e.webp"].status == "unsupported" and scanned["B.PNG"].channels == 1
    found = {os.path.basename(r.path): r for r in api.classify(spark, folder).collect()}
    assert len(found) == 6 and found["broken.jpg"].label is None and found["a.png"].label in S.LABELS and 0.5 <= found["a.png"].confidence <= 1
    assert found["a.png"].explanation.startswith("Classification: ") and found["a.png"].method == "voting"
    n = {r.label: r.n for r in api.batch_summary(spark, folder).collect()}
    assert set(n) == set(S.LABELS) and sum(n.values()) == 4


def test_features_with_metadata(spark, folder):
    rows = {os.path.basename(r.path): r for r in api.image_features(spark, folder).collect()}
    assert all(n in rows["a.png"].asDict() for n in S.FEATURES)
    d = rows["d.jpg"]
    assert (d.width, d.height) == (24, 33) and d.meta_has_camera == 1 and d.meta_camera_tags == 2 and d.meta_has_gps == 1 and d.meta_has_software == 1 and d.meta_has_timestamps == 1
    assert rows["a.png"].meta_tag_count == 0 and rows["broken.jpg"].spectral_slope is None


def test_train_save_load_predict(spark, tmp_path):
    rng = np.random.default_rng(2)
    for kind, s in (("real", 60), ("ai", 3)):
        os.mkdir(tmp_path / kind)
        for k in range(5):
            a = np.clip(128 + rng.normal(0, s, (48, 48, 3)), 0, 255).astype(np.uint8)
            (tmp_path / kind / f"{k}.png").write_bytes(png(a))
    t = api.train(spark, str(tmp_path / "real"), str(tmp_path / "ai"), str(tmp_path / "m"))
    assert t.counts == {0: 20, 1: 20} and t.train_accuracy > 0.9 and 0 <= t.cv_mean <= 1
    acc, report = api.evaluate(spark, str(tmp_path / "real"), str(tmp_path / "ai"), str(tmp_path / "m"))
    assert acc.first().accuracy >= 0.8 and report.count() == 4
    p = api.classify(spark, str(tmp_path / "ai"), str(tmp_path / "m")).first()
    assert p.method == "svm" and 0.5 <= p.confidence <= 1
    j = json.loads(M.response(api.classify(spark, str(tmp_path / "ai"))).first().json)
    assert set(j["scores"]) == set(S.WEIGHTS) and j["label"] in S.LABELS
    with pytest.raises(RuntimeError):
        M.save(None, spark, str(tmp_path / "x"))
    with pytest.raises(FileNotFoundError):
        M.load(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        M.load(spark, str(tmp_path / "m"), ("other",))


def test_validation_and_cli(tmp_path, capsys):
    with pytest.raises(FileNotFoundError):
        I.validate_path(str(tmp_path / "no.png"))
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        I.validate_path(str(tmp_path / "a.txt"))
    assert cli.main([]) == 1 and cli.main(["--image", str(tmp_path / "a.txt")]) == 1


def test_data_set_tools(spark, tmp_path, capsys):
    """Ingest, split and verify, as the command line does them."""
    source = tmp_path / "in"
    os.mkdir(source)
    for k in range(12):
        (source / f"{k:02d} {('Kling', 'x')[k % 2]}.PNG").write_bytes(png(np.full((4, 5, 3), k, np.uint8)))
    (source / "notes.txt").write_text("x")
    for name in ("real", "ai"):
        assert cli.main(["--ingest", str(source), str(tmp_path / name)]) == 0
    names = sorted(os.listdir(tmp_path / "ai"))
    assert [n for n in names if not n.startswith(".")] == sorted(f"ai_{('kling', 'misc')[k % 2]}_img_{k + 1:03d}.PNG" for k in range(12))
    assert (tmp_path / "ai" / "ai_misc_img_004.PNG").read_bytes() == (source / "03 x.PNG").read_bytes()
    folders = [str(tmp_path / "real"), str(tmp_path / "ai"), str(tmp_path / "test")]
    assert cli.main(["--prepare", *folders, "--skip-split"]) == 0 and not os.path.exists(folders[2])
    assert cli.main(["--prepare", *folders, "--ai-only"]) == 0
    count = lambda *d: len([n for n in os.listdir(tmp_path.joinpath(*d)) if n.endswith("PNG")])
    assert (count("ai"), count("test", "ai"), count("real")) == (2, 10, 12)
    assert cli.main(["--prepare", *folders]) == 0 and (count("ai"), count("test", "ai"), count("test", "real")) == (2, 10, 10)
    (tmp_path / "real" / "empty.png").write_bytes(b"")
    (tmp_path / "real" / "broken.png").write_bytes(b"x")
    report = {r.dir: r for r in api.verify(spark, folders[:2]).collect()}
    assert (report[folders[0]].n, report[folders[0]].corrupt, report[folders[0]].bad_files) == (4, 2, ["broken.png", "empty.png"]) and report[folders[1]].passed
    assert cli.main(["--verify", *folders[:2]]) == 1 and cli.main(["--verify", *folders[:2], "--ai-only"]) == 0
    assert api.split(spark, folders[1], str(tmp_path / "few"), least=10) == 0


def test_extra_folders_bring_their_metadata(spark, folder, tmp_path):
    found = I.labelled(spark, folder, folder, f"file://{folder}", str(tmp_path / "nothing"))
    assert found.groupBy("label").count().orderBy("label").collect() == [(0, 12), (1, 6)]
    paths = [r.path for r in I.scan_images(spark, folder, ordered=True).collect()]
    assert paths == sorted(paths)


def test_stream_of_files(spark, folder, tmp_path):
    q = stream.classify_arriving(spark, folder, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
