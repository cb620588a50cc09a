import numpy as np
import pytest

from readloom.llm import media
from readloom.llm import progressive_jpeg as jpeg


def coefficients(rng, kind, n):
    if kind == "any":
        return rng.integers(-128, 128, (n, 64))
    if kind == "sparse":
        return np.where(rng.random((n, 64)) < 0.05, rng.integers(-3, 4, (n, 64)), 0)
    if kind == "small":
        return rng.integers(-2, 3, (n, 64))
    return np.zeros((n, 64), int)


@pytest.mark.parametrize("kind", ["any", "sparse", "small", "zero"])
def test_files_give_their_coefficients(kind):
    rng = np.random.default_rng(1)
    shapes = [(int(rng.integers(1, 9)), int(rng.integers(1, 4))) for _ in range(25)]
    values = [coefficients(rng, kind, 6 * a * d) for a, d in shapes]
    files = jpeg.write(values, shapes, [b"c"] * 25)
    images, got, _ = jpeg.coefficients(files)
    assert (got == np.concatenate(values)).all()
    assert [(i.width, i.height) for i in images] == [(16 * a, 16 * d) for a, d in shapes]
    alone = [jpeg.write([v], [s], [b"c"])[0] for v, s in zip(values, shapes, strict=True)]
    assert alone == files  # a file doesn't depend on its company


def test_against_another_decoder(spark):
    """The files are read by the Java image library; smooth luma and grey chroma leave no room for upsampling filters."""
    rng = np.random.default_rng(2)
    values = np.zeros((6 * 5 * 2, 64), int)
    values[:40, 0] = rng.integers(-100, 100, 40) * 4
    values[:40, 1:10] = rng.integers(-25, 25, (40, 9))
    (file,) = jpeg.write([values], [(5, 2)], [b"x"])
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(file))
    pixels = np.array([[image.getRGB(x, y) & 0xFFFFFF for x in range(80)] for y in range(32)])
    other = np.stack([pixels >> 16, pixels >> 8 & 255, pixels & 255], -1)
    ours = jpeg.tensors(*jpeg.coefficients([file]))[0].astype(int)
    assert ours.shape == (32, 80, 3) and abs(ours - other).max() <= 2


def test_reads_what_the_java_library_writes(spark):
    """A progressive file of another encoder, with its own tables and end-of-block runs, without restart intervals."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(37, 29, 1)
    truth = np.zeros((29, 37, 3), int)
    for y in range(29):
        for x in range(37):
            truth[y, x] = (40 + 5 * x, 60 + 4 * y, 200 - 3 * x)
            image.setRGB(x, y, int(truth[y, x, 0] << 16 | truth[y, x, 1] << 8 | truth[y, x, 2]))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    parameters = writer.getDefaultWriteParam()
    parameters.setProgressiveMode(1)  # the library's default scans
    parameters.setCompressionMode(2)
    parameters.setCompressionQuality(1.0)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), parameters)
    stream.flush()
    file = bytes(out.toByteArray())
    assert file.find(b"\xff\xc2") > 0
    images, values, origin = jpeg.coefficients([file, file])
    one, two = jpeg.tensors(images, values, origin)
    assert (one == two).all() and one.shape == (29, 37, 3)
    assert abs(one.astype(int) - truth).mean() < 4


def test_errors():
    (file,) = media.store([b"\0" * 64])
    for bad in (b"", b"no jpeg", file[:40], file.replace(b"\xff\xc2", b"\xff\xc0")):
        with pytest.raises(ValueError):
            jpeg.coefficients([bad])


def test_payloads():
    rng = np.random.default_rng(3)
    payloads = [bytes(rng.integers(0, 256, 64 * n, dtype=np.uint8)) for n in (1, 2, 5, 6, 7, 100, 5000)] + [b"\xff" * 640, b"\x80" * 640, b"\x7f\x81" * 320]
    files = media.store(payloads)
    read = media.load(files)
    assert [p for p, _ in read] == payloads
    assert all(rgb.dtype == np.uint8 and rgb.shape[2] == 3 for _, rgb in read)
    wide = media.store([bytes(64) * 6 * (media.MOST_ACROSS + 1)])
    assert media.load(wide)[0][1].shape == (32, 16 * media.MOST_ACROSS, 3)


def test_operator(frame, awkward):
    out = media.media_columns(frame(awkward)).collect()
    assert len(out) == len(awkward)
    by_text: dict = {}
    for r, (i, t) in zip(sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"])), sorted(awkward, key=lambda r: (r[0] is None, r[0] or 0, len((r[1] or "").encode()))), strict=True):
        raw = (t or "").encode()
        assert r["doc_id"] == i and r["n_bytes"] == len(raw)
        assert r["payload"] == raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert len(r["rgb"]) == r["width"] * r["height"] * 3
        assert by_text.setdefault(raw, (r["media"], r["feature"])) == (r["media"], r["feature"])
    assert media.media_columns(frame([])).count() == 0
