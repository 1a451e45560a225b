import io
import math
import struct
import wave

import numpy as np
import pytest

from quillstone.operators import media
from quillstone.session import Engine


def tone(hz, seconds=1.0, rate=22050, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels), f.setsampwidth(width), f.setframerate(rate)
        x = [0.5 * math.sin(2 * math.pi * hz * t / rate) for t in range(int(seconds * rate))]
        f.writeframes(b"".join(struct.pack("<h", int(32767 * v)) * channels if width == 2 else bytes([int(128 + 127 * v)]) * channels for v in x))
    return out.getvalue()


@pytest.mark.parametrize("hz,pitch", [(261.63, 0), (440.0, 9), (466.16, 10), (880.0, 9)])
def test_chroma_names_the_note(hz, pitch):
    x = media.chroma(tone(hz))
    assert x.shape == (44, 12) and (x[5:-5].argmax(axis=1) == pitch).all() and x.max() == 1


def test_chroma_stands_other_rates_and_silence():
    assert (media.chroma(tone(440, rate=8000))[5:-5].argmax(axis=1) == 9).all()
    assert (media.chroma(tone(440, channels=2, width=1))[5:-5].argmax(axis=1) == 9).all()
    assert media.chroma(tone(0)).max() == 0 and media.chroma(b"no sound").shape == (0, 12) and media.mfcc(b"").shape == (0, 13)


def test_mfcc_against_plain_sums():
    data = tone(700, 0.2)
    x, rate = media.samples(data, media.RATE)
    got, bands = media.mfcc(data), media.mel_filters(128)
    assert rate == 22050 and got.shape == (1 + len(x) // 512, 13)
    padded = np.concatenate([np.zeros(1024), x, np.zeros(1024)])
    level = np.zeros((len(got), 128))
    for t in range(len(got)):
        frame = padded[512 * t : 512 * t + 2048] * [0.5 * (1 - math.cos(2 * math.pi * i / 2048)) for i in range(2048)]
        power = [abs(sum(frame * np.exp(-2j * math.pi * k * np.arange(2048) / 2048))) ** 2 for k in range(1025)] if t == 4 else np.abs(np.fft.fft(frame)[:1025]) ** 2
        level[t] = [10 * math.log10(max(1e-10, float(np.dot(b, power)))) for b in bands]
    level = np.maximum(level, level.max() - 80)
    for c in (0, 1, 12):
        want = [sum(v * math.cos(math.pi * c * (2 * b + 1) / 256) for b, v in enumerate(row)) * math.sqrt((1 if c == 0 else 2) / 128) for row in level]
        np.testing.assert_allclose(got[:, c], want, atol=1e-6)


def test_mel_filters_cover_the_range():
    f = media.mel_filters(40)
    centres = (f * np.fft.rfftfreq(2048, 1 / 22050)).sum(axis=1) / f.sum(axis=1)
    assert (np.diff(centres) > 0).all() and (f >= 0).all()
    np.testing.assert_allclose(f[20:].sum(axis=1) * 22050 / 2048, 1, atol=0.05)  # triangles of unit area


def test_hog_sees_edges():
    side = np.zeros((128, 128))
    side[:, 64:] = 200
    flat, upright, across = media.hog(np.full((50, 80), 7.0)), media.hog(side), media.hog(side.T)
    assert flat.shape == upright.shape == (1, 9 * 3780) and not flat.any()
    bins = lambda v: v.reshape(-1, 9).sum(axis=0)
    assert bins(upright).argmax() in (0, 8) and bins(across).argmax() == 4
    blocks = upright.reshape(-1, 36)
    assert (np.sqrt((blocks**2).sum(axis=1)) <= 1 + 1e-6).all()


def test_quantiser_by_matrix_agrees_with_expressions(spark, monkeypatch):
    r = np.random.default_rng(2)
    words = r.normal(size=(7, 5)).tolist()
    df = spark.createDataFrame([(i, r.normal(size=5).tolist()) for i in range(60)] + [(99, words[3])], "key long, vector array<double>")
    inline = sorted(map(tuple, media.quantised(df, words).collect()))
    monkeypatch.setattr(media, "INLINE", 0)
    assert sorted(map(tuple, media.quantised(df, words).collect())) == inline and (99, 3) in inline


def test_images_by_hog(spark, tmp_path):
    """Spark decodes the images; upright and level stripes are told apart."""
    image_io = spark._jvm.javax.imageio.ImageIO
    (tmp_path / "img").mkdir()
    for i in range(1, 7):
        picture = spark._jvm.java.awt.image.BufferedImage(32, 32, 5)
        for x in range(32):
            for y in range(32):
                on = ((x if i % 2 else y) // (2 + i // 3)) % 2
                picture.setRGB(x, y, 0xFFFFFF if on else 0)
        image_io.write(picture, "png", spark._jvm.java.io.File(f"{tmp_path}/img/{i}.png"))
    (tmp_path / "img" / "note.txt").write_text("no image")
    engine = Engine(spark, f"file://{tmp_path}/db")
    engine.sql("CREATE TABLE s (id INT KEY)")
    engine.insert("s", spark.createDataFrame([(i,) for i in range(1, 8)], "id int"))
    assert "ERROR" in engine.sql(f'CREATE INDEX ON s USING MULTIMEDIA_SEQ FEATURE "MFCC" DIRECTORY "file://{tmp_path}/img" PATTERN "{{id}}.png"').message
    table = engine.catalog.table("s")
    table.indexes["MULTIMEDIA"] = {"kind": "MULTIMEDIA_SEQ", "feature": "HOG", "directory": f"file://{tmp_path}/img", "pattern": "{id}.png"}
    engine._build_media(table, words=2)
    stats = engine.media_statistics("s")
    assert stats["rows"] == 6 and stats["descriptors"] == 6 and stats["words"] == 2 and stats["feature"] == "HOG"
    best = [r.id for r in engine.sql('SELECT id FROM s WHERE id <-> "1.png" LIMIT 2').data.collect()]
    assert sorted(best) == [3, 5]
