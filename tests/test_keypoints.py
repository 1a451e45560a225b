import numpy as np
import pytest

from quillstone.operators import keypoints as kp
from quillstone.operators import media


def picture(seed=1, size=160):
    """Boxes and discs of random brightness."""
    r = np.random.default_rng(seed)
    x = np.full((size, size), 90.0)
    yy, xx = np.mgrid[:size, :size]
    for _ in range(25):
        cy, cx, n, v = r.integers(25, size - 25), r.integers(25, size - 25), r.integers(4, 14), r.integers(0, 255)
        x[((yy - cy) ** 2 + (xx - cx) ** 2 <= n * n) if r.random() < 0.5 else ((abs(yy - cy) <= n) & (abs(xx - cx) <= n))] = v
    return x


def matched(a, b, near):
    """The share of a's descriptors whose nearest one in b is nearer than near."""
    gap = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).min(axis=1)
    return (gap < near).mean()


def bits(x):
    return np.unpackbits(x.astype(np.uint8), axis=1).astype(float)


@pytest.mark.parametrize("turn", [lambda x: np.rot90(x), lambda x: np.roll(x, (8, -8), axis=(0, 1)), lambda x: x * 0.7 + 30])
def test_sift_finds_the_same_picture_turned_moved_and_relit(turn):
    a, b, other = kp.sift(picture()), kp.sift(turn(picture())), kp.sift(picture(2))
    assert 20 < len(a) <= kp.MOST and a.shape[1] == 128 and a.min() >= 0 and a.max() <= 255
    assert matched(a, b, 120) > 0.7 > 0.3 > matched(a, other, 120)


@pytest.mark.parametrize("turn", [lambda x: np.rot90(x), lambda x: np.roll(x, (8, -8), axis=(0, 1)), lambda x: x * 0.9 + 10])
def test_orb_finds_the_same_picture_turned_moved_and_relit(turn):
    # corners of plain shapes look alike in any picture: texture tells pictures apart
    textured = lambda seed: (picture(seed) / 2 + 600 * kp.blurred(np.random.default_rng(seed).normal(size=(160, 160)), 2.5)).clip(0, 255)
    a, b, other = (bits(kp.orb(x)) for x in (textured(1), turn(textured(1)), textured(2)))
    assert 10 < len(a) <= kp.MOST
    assert matched(a, b, 6) > 0.5 > 0.25 > matched(a, other, 6)


def test_flat_small_and_large_images():
    for run, width in ((kp.sift, 128), (kp.orb, 32)):
        assert run(np.full((90, 90), 7.0)).shape == (0, width) and run(np.zeros((8, 8))).shape == (0, width)
    assert kp.sift(media.resized(picture(3, 80), 40, 1300)).shape[1] == 128


def test_blur_keeps_the_mean_and_spreads():
    x = np.zeros((41, 41))
    x[20, 20] = 1
    b = kp.blurred(x, 2.0)
    yy = np.arange(41) - 20
    assert abs(b.sum() - 1) < 1e-9 and abs((b.sum(axis=1) * yy**2).sum() - 4) < 0.05
