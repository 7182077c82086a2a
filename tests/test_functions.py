import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import images as I  # noqa: E741
from docloom.functions import numeric, text
from docloom.operators import signals


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def values(df, c):
    return [r.x for r in df.select("i", c.alias("x")).orderBy("i").collect()]


def test_normalize(spark):
    given = ["  Hello   World  \r\n\r\n  ", "Hello\x00\x01World\t\n", "", None, "a\rb", " x \ny　"]
    df = column(spark, given)
    once = values(df, text.normalize(F.col("v")))
    assert once == ["Hello World\n\n", "HelloWorld\n", "", "", "a\nb", "x\ny"]
    assert values(column(spark, once), text.normalize(F.col("v"))) == once


def test_words_and_lengths(spark):
    df = column(spark, ["", "  ", "a b\n c", None, " x "])
    assert values(df, text.word_count(F.col("v"))) == [0, 0, 3, 0, 1]
    assert values(df, text.text_length(F.col("v"))) == [0, 0, 6, 0, 1]
    assert values(df, text.density(F.lit(10), F.lit(0.0), F.lit(5.0))) == [0.0] * 5


def test_numbers(spark):
    given = ["123", "123.45", "1,234", "$123", "(123)", "-123.45", "12.5%", "abc", "", None, "$(5)", "(5)%", "1 234", "12d"]
    df = column(spark, given)
    assert values(df, numeric.number_in(F.col("v"))) == [123, 123.45, 1234, 123, -123, -123.45, 12.5, None, None, None, None, None, 1234, None]
    assert values(df, numeric.numeric_like(F.col("v")))[10:] == [True, True, False, False]


def test_checksum_and_ids(spark):
    df = column(spark, [b"Hello, World!"], "binary")
    assert values(df, text.checksum(F.col("v"))) == [hashlib.sha256(b"Hello, World!").hexdigest()]
    df = column(spark, ["A" * 64, "g" * 64, None, "12345678-1234-1234-1234-123456789abc", "no"])
    assert values(df, text.is_checksum(F.col("v"))) == [True, False, False, False, False]
    assert values(df, text.is_uuid(F.col("v"))) == [False, False, False, True, False]


def test_tokens(spark):
    assert values(column(spark, [["a", " ", "b ", ""]], "array<string>"), text.join_tokens(F.col("v"))) == ["a b"]


def test_clusters_against_loop(spark):
    rng = random.Random(2)
    lists = [[rng.uniform(0, 20) for _ in range(rng.randint(0, 12))] for _ in range(50)]

    def slow(xs):
        n, start = 0, None
        for x in sorted(xs):
            if start is None or x - start > 1.5:
                n, start = n + 1, x
        return n

    assert values(column(spark, lists, "array<double>"), signals.clusters(F.col("v"), F.lit(1.5))) == [slow(x) for x in lists]


def test_patterns_against_loop():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (7, 9)).astype(np.uint8)
    want = np.zeros_like(x)
    around = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))
    for i in range(1, 6):
        for j in range(1, 8):
            want[i, j] = sum((x[i + a, j + b] >= x[i, j]) << (7 - k) for k, (a, b) in enumerate(around))
    assert (I.local_binary_patterns(x) == want).all()
    assert I.pattern_histogram(x).sum() == pytest.approx(1)


def test_images():
    x = np.full((40, 60), 255, np.uint8)
    x[10:20, 20:30] = 0
    assert I.remove_borders(x, padding=0).shape == (10, 10)
    assert I.remove_borders(np.full((4, 4), 255, np.uint8)).shape == (4, 4)
    assert set(np.unique(I.binarize(x))) == {0, 255}
    assert (I.morphology(x, "erode") <= x).all() and (I.morphology(x, "dilate") >= x).all()
    assert I.shrink(x, 30).shape == (20, 30)
    assert I.ruled_lines(np.zeros((3, 9), np.uint8), 0) == [0, 1, 2]
    assert I.texture(np.full((5, 5), 9, np.uint8))[:3].tolist() == [9, 0, 0]
    flipped = I.hu_moments(np.rot90(x, 2))
    assert np.allclose(I.hu_moments(x), flipped, atol=1e-6)
    assert [c[0] for c in I.legend_corners(x)] == []
    busy = np.full((40, 40), 255, np.uint8)
    busy[:10:2, :10] = 0
    assert [(c[0], c[1], c[2], c[3], c[4]) for c in I.legend_corners(busy)] == [("top_left", 0, 0, 10, 0.9)]


def test_values_of_image_steps():
    """Against the definitions, pixel by pixel."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 256, (13, 17)).astype(np.uint8)
    padded = lambda n: np.pad(x.astype(float), n, mode="edge")
    w5, w11, near = I.bell(5), I.bell(11), np.arange(9) - 4
    assert w5 == pytest.approx(np.exp(-np.arange(-2, 3) ** 2 / (2 * 1.1**2)) / np.exp(-np.arange(-2, 3) ** 2 / (2 * 1.1**2)).sum())
    for i in range(13):
        for j in range(17):
            a, b, c = padded(2)[i : i + 5, j : j + 5], padded(5)[i : i + 11, j : j + 11], padded(4)[i : i + 9, j : j + 9]
            assert abs(I.gaussian(x)[i, j] - w5 @ a @ w5) <= 0.51
            assert I.median(x)[i, j] == int(np.median(a))
            assert (I.adaptive(x)[i, j] == 255) == (x[i, j] > np.round(w11 @ b @ w11) - 2)
            like = np.exp(-(near[:, None] ** 2 + near**2) / (2 * 75**2)) * np.exp(-((c - x[i, j]) ** 2) / (2 * 75**2))
            assert abs(I.bilateral(x)[i, j] - (c * like).sum() / like.sum()) <= 0.51
    level = max(range(255), key=lambda t: (x <= t).mean() * (x > t).mean() * (x[x <= t].mean() - x[x > t].mean()) ** 2 if (x <= t).any() and (x > t).any() else 0)
    assert (I.binarize(x) == np.where(x > level, 255, 0)).all() and (I.binarize(x, "fixed") == np.where(x > 127, 255, 0)).all()
    with pytest.raises(ValueError):
        I.binarize(x, "other")
    assert I.stretch(np.array([[10, 20, 60]], np.uint8)).tolist() == [[0, 51, 255]] and I.equalize(np.array([[7, 7, 9, 11]], np.uint8)).tolist() == [[0, 0, 128, 255]]


def test_uneven_light_needs_the_surroundings():
    """Dark strokes on a page that gets darker to the right: one level can not tell them from the page, each pixel's surroundings can."""
    page = np.tile(np.linspace(250, 60, 200), (60, 1))
    strokes = np.zeros(page.shape, bool)
    strokes[10:50, 10::20] = True
    page[strokes] -= 40
    wrong = lambda b: ((b == 0) != strokes).mean()
    image = page.astype(np.uint8)
    assert wrong(I.binarize(image, "adaptive")) < 0.03 < 0.3 < wrong(I.binarize(image))
    assert I.local_contrast(image).std() > image[:, :25].std() and I.sharpen(image).shape == image.shape


def test_lines_and_gradients():
    x = np.full((60, 80), 255, np.uint8)
    x[10:12, 5:75] = 0
    x[40, 5:75] = 0
    x[10:41, [5, 40, 74]] = 0
    assert I.ruled_segments(x, 0) == [(10, 5, 74), (40, 5, 74)] and I.ruled_segments(x, 1) == [(5, 10, 40), (40, 10, 40), (74, 10, 40)]
    assert (I.line_opening(255 - x, 25, 1)[10, 5:75] == 255).all() and not I.line_opening(255 - x, 40, 0).any()
    slope = np.tile(np.arange(64, dtype=np.uint8) * 3, (64, 1))
    h = I.oriented_gradients(slope).reshape(49, 4, 9)
    assert h.shape == (49, 4, 9) and (h.sum(axis=(0, 1))[1:8] < 1e-6).all() and np.allclose(h, np.flip(h, axis=2))


def test_hu_moments_by_hand():
    x = np.zeros((9, 9), np.uint8)
    x[2:5, 3:8] = 100
    ys, xs = np.nonzero(x)
    n20, n02 = ((xs - xs.mean()) ** 2).sum() / len(xs) ** 2, ((ys - ys.mean()) ** 2).sum() / len(xs) ** 2
    assert I.hu_moments(x)[0] == pytest.approx(-np.log10((n20 + n02) / 100 + 1e-10)) and I.hu_moments(x)[1] == pytest.approx(-np.log10(((n20 - n02) / 100) ** 2 + 1e-10))


def test_faulty_pictures_are_rows(spark):
    from docloom.operators import images, tables

    page = np.full((60, 80), 255, np.uint8)
    page[[10, 25, 40], 5:75] = 0
    page[10:41, [5, 40, 74]] = 0
    rows = [(1, "d", 1, "visual", 60, 80, page.tobytes()), (2, "d", 2, "light", 3, 3, b"x"), (3, "d", 3, "light", None, 3, None), (4, "d", 4, "ocr_optimized", 0, 0, b"")]
    df = spark.createDataFrame(rows, "image_id long, document_id string, page_number int, profile string, height int, width int, data binary")
    for got in (images.preprocess(df).collect(), images.features(df).collect()):
        assert [r.image_id for r in got if r.error is None] == [1] and len(got) == 4
    assert images.legends(df).filter("error is not null").count() == 3
    for name in images.PIPELINES:
        assert images.preprocess(df.limit(1).withColumn("profile", F.lit(name))).first().error is None
    found = images.segments(df)
    grid = tables.from_segments(found).first()
    assert found.filter("error is not null").count() == 3 and (grid.page_number, grid.row_count, grid.column_count) == (1, 2, 2)
    assert tables.cells(tables.from_segments(found)).count() == 4


def test_components_against_a_flood():
    rng = np.random.default_rng(6)
    from docloom.functions import regions as R

    for _ in range(20):
        mask = rng.random((12, 15)) < 0.35
        seen, boxes = np.zeros(mask.shape, bool), []
        for y, x in zip(*np.nonzero(mask)):
            if seen[y, x]:
                continue
            stack, part = [(y, x)], []
            seen[y, x] = True
            while stack:
                a, b = stack.pop()
                part.append((a, b))
                for c in range(max(0, a - 1), min(12, a + 2)):
                    for d in range(max(0, b - 1), min(15, b + 2)):
                        if mask[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            stack.append((c, d))
            ys, xs = np.array(part).T
            area = sum(xs[ys == r].max() - xs[ys == r].min() + 1 for r in set(ys.tolist()))
            boxes.append((xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1, len(part), area))
        assert sorted(tuple(c.values()) for c in R.components(mask)) == sorted(boxes)


def test_edges_skew_and_regions(spark):
    from docloom.functions import regions as R
    from docloom.operators import images, tables

    page = np.full((120, 160), 255, np.uint8)
    page[40:80, 50:110] = 20
    mask = R.edges(page, 50, 150)
    ys, xs = np.nonzero(mask)
    assert {(ys.min(), ys.max()), (xs.min(), xs.max())} <= {(39, 79), (40, 80), (39, 80), (40, 79), (49, 109), (50, 110), (49, 110), (50, 109)} and len(R.components(mask)) == 1
    lines = np.full((200, 300), 255, np.uint8)
    lines[20:180:16, 20:280] = 0
    for degrees in (-3.0, 0.0, 2.0):
        assert abs(R.skew(R.turned(lines, degrees)) - degrees) <= 0.5
    assert R.skew(R.deskew(R.turned(lines, 3.0))) == pytest.approx(0, abs=0.5) and R.skew(np.full((9, 9), 255, np.uint8)) == 0
    assert [k for k, _, _ in R.regions(page, "chart_graph")][-1] == "chart_data_elements" and R.regions(page, "typed_text") == []
    bands = dict((k, b) for k, _, b in R.regions(page, "map_diagram"))["intensity_bands"]
    assert len(bands) == 4 and all((b["x"], b["y"], b["width"], b["height"], b["area"]) == (50, 40, 60, 40, 2400) for b in bands)
    assert R.shape(page)[3] == 1 and R.shape(np.zeros((9, 9), np.uint8)).tolist() == [0] * 5
    grid = np.full((60, 80), 255, np.uint8)
    grid[[10, 25, 40], 5:75] = 0
    grid[10:41, [5, 40, 74]] = 0
    df = spark.createDataFrame([(1, "d", 1, "table_dense", 60, 80, grid.tobytes()), (2, "d", 2, "map_diagram", 0, 0, None)], "image_id long, document_id string, page_number int, classification string, height int, width int, data binary")
    got = images.regions(df).collect()
    assert [(r.kind, r["count"], r.error is None) for r in got] == [("table_structure", 6, True), (None, None, False)]
    found = tables.from_segments(images.segments(df))
    crops = images.cell_pictures(df, tables.cells(found)).collect()
    assert sorted((r.row_index, r.column_index, r.height, r.width) for r in crops) == [(0, 0, 15, 35), (0, 1, 15, 34), (1, 0, 15, 35), (1, 1, 15, 34)]
    texts = spark.createDataFrame([("d", 1, 0, 0, "a", 0.5), ("d", 1, 1, 1, "b", 0.7), ("d", 1, 1, 0, None, 0.0)], "document_id string, page_number int, row_index int, column_index int, text string, confidence double")
    r = tables.filled(found, texts).first()
    assert r.table_data == [["a", ""], ["", "b"]] and r.extraction_confidence == pytest.approx(0.6)
    assert tables.filled(found, texts.limit(0)).first().extraction_confidence == 0


def test_straight_lines():
    from docloom.functions import regions as R

    mask = np.zeros((80, 90), bool)
    mask[30, 5:85] = True
    mask[np.arange(70), np.arange(70) + 10] = True
    got = R.straight_lines(mask, 50)
    assert got[0][0] == 30 and got[0][1] == pytest.approx(np.pi / 2) and got[0][2] >= 80
    assert any(abs(np.degrees(a) - 135) <= 1 and n >= 50 for _, a, n in got) and R.straight_lines(np.zeros((9, 9), bool)) == []


def test_line_features(spark):
    df = column(spark, [[0.0, 10.0, 20.0, 40.0], [1.0], []], "array<double>")
    got = values(df, signals.line_features(F.transform("v", lambda x: x + 5), F.col("v")))
    gaps = np.array([10, 10, 20])
    assert got[0].line_count == 4 and got[0].average_length == 22.5 and got[0].regularity == pytest.approx(1 - gaps.var() / (gaps.mean() + 1e-6))
    assert tuple(got[1]) == (1, 6.0, 0.0, 0.0) and tuple(got[2]) == (0, 0.0, 0.0, 0.0)


def test_small_frames_are_dealt_out(spark, tmp_path):
    from docloom.functions.frames import LEAST_BYTES, spread

    spark.range(50).coalesce(1).write.parquet(str(tmp_path / "few"))
    few = spark.read.parquet(str(tmp_path / "few"))
    assert few.rdd.getNumPartitions() == 1 and spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(r.id for r in spread(few).collect()) == list(range(50))
    many = spark.range(100 * LEAST_BYTES)
    assert spread(many) is many
