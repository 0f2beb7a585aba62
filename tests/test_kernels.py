"""Image kernels against plain loops and known pictures."""

import numpy as np
import pytest

from pagewright.operators import raster


def page(h=700, w=500):
    """Lines of words in dark bars, and two rules."""
    rng = np.random.default_rng(3)
    img = np.full((h, w), 235, np.uint8)
    for y in range(60, h - 60, 24):
        x = 50
        while x < w - 90:
            n = int(rng.integers(15, 60))
            img[y : y + 8, x : x + n] = 40
            x += n + 9
    img[40:42, 40 : w - 40] = img[h - 42 : h - 40, 40 : w - 40] = 30
    return img


def turned(img, degrees, fill=235):
    h, w = img.shape[:2]
    a = np.radians(degrees)
    c, s, cx, cy = np.cos(a), np.sin(a), w / 2, h / 2
    return raster.warp(img, np.array([[c, -s, cx - c * cx + s * cy], [s, c, cy - s * cx - c * cy], [0, 0, 1.0]]), w, h, np.array(fill))


@pytest.mark.parametrize("degrees", [-22, -7.5, -2, 0, 0.3, 3, 12, 25])
def test_skew_of_lines(degrees):
    found = raster.skew_angle(turned(page(), -degrees))
    assert abs(found - (degrees if abs(degrees) >= 0.55 else 0)) < 0.5
    straight = raster.deskew(turned(page(), -degrees))
    assert abs(raster.skew_angle(straight)) < 0.6


def test_skew_without_lines():
    assert raster.skew_angle(np.full((300, 200), 250, np.uint8)) == 0.0
    dots = np.full((600, 400), 240, np.uint8)
    for y in range(30, 570, 20):
        dots[y : y + 5, 30:370:9] = 20
    assert abs(raster.skew_angle(turned(dots, -6, 240)) - 6) < 1


def test_weighted_median_drops_outliers():
    assert raster.weighted_median(np.array([1.0, 1.1, 1.2, 1.3, 1.4, 29.0]), np.array([1, 1, 1, 5, 1, 90.0])) == 1.3


def test_area_means_against_loops():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (13, 17), np.uint8)
    h, w = 5, 4
    want = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            y0, y1, x0, x1 = y * 13 / h, (y + 1) * 13 / h, x * 17 / w, (x + 1) * 17 / w
            for j in range(13):
                for i in range(17):
                    share = max(0, min(y1, j + 1) - max(y0, j)) * max(0, min(x1, i + 1) - max(x0, i))
                    want[y, x] += share * img[j, i]
            want[y, x] /= (y1 - y0) * (x1 - x0)
    assert np.abs(raster.area_resize(img, w, h) - want).max() <= 0.5 + 1e-9
    assert raster.shrink(np.zeros((2001, 7), np.uint8)).shape[0] == 2000 and raster.shrink(np.zeros((2500, 1250, 3), np.uint8)).shape == (2000, 1000, 3)
    assert raster.shrink(np.zeros((4100, 41), np.uint8)).shape == (2000, 20) and raster.shrink(img) is img
    assert raster.thumbnail(np.zeros((1000, 500), np.uint8)).shape == (120, 60) and raster.thumbnail(np.zeros((500, 1000, 3), np.uint8)).shape == (45, 90, 3)


def test_bilateral_against_loops():
    rng = np.random.default_rng(2)
    img = rng.integers(0, 256, (9, 8), np.uint8)
    r, sigma = int(5 + 4 * 0.5) // 2, float(int(20 + 35 * 0.5))
    want = np.zeros(img.shape)
    for y in range(9):
        for x in range(8):
            total = weight = 0.0
            for dy in range(-r, r + 1):
                for dx in range(-r, r + 1):
                    if dy * dy + dx * dx <= r * r:
                        v = float(img[min(8, max(0, y + dy)), min(7, max(0, x + dx))])
                        k = np.exp(-(dy * dy + dx * dx) / (2 * sigma**2) - (v - float(img[y, x])) ** 2 / (2 * sigma**2))
                        total, weight = total + v * k, weight + k
            want[y, x] = total / weight
    assert np.abs(raster.denoise(img, 0.5) - want).max() <= 0.5 + 1e-9


def test_threshold_finds_faint_strokes_in_shadow():
    img = (np.full((120, 160), 220.0) * np.linspace(1, 0.4, 160)[None]).astype(np.uint8)
    img[50:54, 20:140] = (img[50:54, 20:140] * 0.7).astype(np.uint8)
    straight, black, angle = raster.order_page(img)
    assert angle == 0.0 and straight is img and (black[51:53, 25:135] == 0).all() and (black[20:40] == 255).mean() > 0.99
    assert set(np.unique(black)) <= {0, 255} and raster.order_page(img, threshold=False)[1].shape == img.shape


def test_whitening_keeps_colour():
    img = np.full((80, 80, 3), (190, 200, 205), np.uint8)
    img[30:50, 30:50] = (40, 40, 200)  # a red stamp
    out = raster.whiten(img, 1.0).astype(int)
    assert np.ptp(out[5, 5]) <= 5 and out[40, 40, 2] - out[40, 40, 0] > 80
    assert raster.chroma(np.array([[[90, 90, 90]]], np.uint8)).max() < 0.1


def scene(corners, h=600, w=800, sheet=245, desk=60):
    """A bright convex sheet on a darker desk, with some writing."""
    y, x = np.mgrid[0:h, 0:w]
    inside = np.ones((h, w), bool)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        inside &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0
    img = np.full((h, w), desk, np.uint8)
    img[inside] = sheet
    img[250:260, 300:500] = 20
    return img


def test_corners_of_a_sheet_and_of_one_with_a_corner_cut_off():
    four = [(100, 70), (690, 90), (660, 540), (120, 520)]
    assert np.abs(raster.find_document(scene(four)) - four).max() < 12
    five = [(150, 72), (690, 90), (660, 540), (120, 520), (103, 115)]
    assert np.abs(raster.find_document(scene(five)) - four).max() < 14
    assert raster.find_document(scene([(380, 280), (420, 280), (420, 320), (380, 320)])) is None


def test_corners_of_lines_alone():
    img = np.full((300, 400), 128, np.uint8)
    img[40:42, 30:370] = img[258:260, 30:370] = img[40:260, 30:32] = img[40:260, 368:370] = 10
    four = raster.corners_of_lines(img)
    assert np.abs(four - [(30, 40), (369, 40), (369, 259), (30, 259)]).max() < 8
    assert raster.corners_of_lines(np.full((100, 100), 9, np.uint8)) is None


def test_regions_by_area():
    mask = np.zeros((20, 30), bool)
    mask[1:4, 1:4] = mask[6:12, 6:16] = mask[14:16, 20:29] = True
    assert [int(r.sum()) for r in raster.regions(mask)] == [60, 18, 9] and [int(r.sum()) for r in raster.regions(mask, 2)] == [60, 18] and raster.regions(mask & False) == []


def test_crops_of_polygons():
    y, x = np.mgrid[0:100, 0:200]
    img = (x + y // 2).astype(np.uint8)  # cubic sampling keeps slopes
    out = raster.crop_polygon(img, np.array([(40, 30), (90, 30), (90, 60), (40, 60)]))
    assert out.shape == (30 + 8, 50 + 8) and abs(int(out[4, 4]) - int(img[30, 40])) <= 1 and abs(int(out[33, 53]) - int(img[60, 90])) <= 1
    tilted = raster.crop_polygon(img, np.array([(40, 30), (88, 44), (80, 72), (32, 58)]), padding=0)
    assert tilted.shape == (29, 50) and abs(int(tilted[0, 0]) - int(img[30, 40])) <= 1
    assert raster.crop_polygon(img, np.array([(1, 1), (4, 1), (4, 9), (1, 9)])) is None and raster.crop_polygon(img, np.zeros((3, 2))) is None
    wide = raster.crop_polygon(img, np.array([(0, 0), (150, 0), (150, 25), (0, 25)]))
    assert wide.shape == (25 + 8, 150 + 8)  # padding follows the height, not the width
    with pytest.raises(ValueError):
        raster.homography(np.zeros((4, 2)), np.zeros((4, 2)))
    assert raster.flatten(img, np.array([(0, 0), (150, 0), (150, 0), (0, 0)])) is img
