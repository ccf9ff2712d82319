"""Display texts and device rules against fixed vectors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane.functions import geometry as g
from corvane.functions import policy as po
from corvane.functions import text as tx
from corvane.operators import hashing, registry, shapes, validate
from corvane.sources import drawing, scan

SIZES = [(0, "0 bytes", "0 byte"), (1023, "1023 bytes", "1023 byte"), (1024, "1.0 KB", "1,0 KB"), (2516582, "2.4 MB", "2,4 MB"), (157286400, "150 MB", "150 MB"), (1048575, "1.0 MB", "1,0 MB"), (104805376, "100 MB", "100 MB"), (5368709120, "5.0 GB", "5,0 GB"), (-1, None, None)]


def test_file_sizes(spark):
    rows = spark.createDataFrame([(b,) for b, _, _ in SIZES], "b long").select(tx.file_size_text(F.col("b")), tx.file_size_text(F.col("b"), "id")).collect()
    assert [tuple(r) for r in rows] == [(a, b) for _, a, b in SIZES]


def test_times(spark):
    now = dt.datetime(2026, 9, 24, 10)
    cases = [(dt.datetime(2026, 9, 24, 9, 59, 30), "Just now"), (dt.datetime(2026, 9, 24, 8, 5), "Today, 8:05 AM"), (dt.datetime(2026, 9, 23, 19, 40), "Yesterday, 7:40 PM"), (dt.datetime(2026, 9, 22, 15, 12), "Sep 22, 3:12 PM"), (dt.datetime(2025, 12, 31, 23, 59), "Dec 31, 2025, 11:59 PM")]
    rows = spark.createDataFrame([(t, now) for t, _ in cases], "t timestamp_ntz, now timestamp_ntz").select(tx.timestamp_text(F.col("t"), F.col("now"))).collect()
    assert [r[0] for r in rows] == [s for _, s in cases]


def test_durations(spark):
    cases = [(0.4, "< 1 second"), (7.0, "7 seconds"), (59.4, "59 seconds"), (59.6, "1 min 0 sec"), (125.0, "2 min 5 sec"), (4800.0, "1 h 20 min")]
    assert [r[0] for r in spark.createDataFrame([(s,) for s, _ in cases], "s double").select(tx.duration_text(F.col("s"))).collect()] == [t for _, t in cases]


def test_extensions(spark):
    cases = [("PNG", ".png"), (".Png", ".png"), (" png ", ".png"), ("", None), (".", None)]
    assert [r[0] for r in spark.createDataFrame([(s,) for s, _ in cases], "s string").select(tx.normalize_extension(F.col("s"))).collect()] == [t for _, t in cases]


SCALES = [(1280, 720, 32, 4, 4, 6.0, 4.0), (1280, 720, 64, 16, 16, 16.0, 16.0), (1280, 720, 8, 2, 2, 2.0, 2.0), (1280, 720, 16, 4, 4, 3.0, 3.0), (1280, 720, 32, 4, 2, 6.0, 2.0), (3840, 2160, 32, 4, 4, 2.0, 2.0), (3840, 2160, 16, 4, 4, 1.0, 1.0), (1600, 1200, 32, 4, 4, 4.157, 4.0), (1600, 1200, 8, 2, 2, 1.386, 1.0), (1600, 1200, 4, 2, 2, 0.0, 0.0)]


def test_scales(spark):
    df = spark.createDataFrame([c[:5] for c in SCALES], "w int, h int, gb int, gpu int, settings int")
    ram = po.ram_max_scale(F.col("w"), F.col("h"), F.col("gb"))
    rows = df.select(ram, po.effective_scale(po.raw_scale(F.col("gpu"), F.col("settings"), ram))).collect()
    for r, c in zip(rows, SCALES, strict=True):
        assert r[0] == pytest.approx(c[5], abs=1e-3) and r[1] == c[6]


def test_gpu_and_ram_tiers(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 5, 6, 8, 11, 12, 15, 16, 24)], "gb int").select(po.gpu_limit(F.col("gb").cast("long") * (1 << 30), F.lit(False)))
    assert [r[0] for r in df.collect()] == [2, 2, 2, 4, 4, 4, 8, 8, 16, 16]
    px = [(2560 * 1440, 8), (2560 * 1440 + 1, 16), (3840 * 2160, 16), (5120 * 2880, 32), (7680 * 4320, 32), (7680 * 4320 + 1, 64)]
    assert [r[0] for r in spark.createDataFrame([(p,) for p, _ in px], "p long").select(po.ram_for_pixels(F.col("p"))).collect()] == [t for _, t in px]
    assert spark.range(1).select(po.whole_gb(F.lit(12282 * (1 << 20)))).first()[0] == 12


def test_settings(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(po.engine_in_use(F.lit("Npu"), F.lit(True), F.lit(False))) == "Gpu"
    assert one(po.engine_in_use(F.lit("Gpu"), F.lit(False), F.lit(False))) == "Cpu"
    assert [one(po.stored_memory_gb(F.lit(s).cast("string"), F.lit(32))) for s in ("64", "1", None)] == [32, 4, 24]
    assert one(po.stored_scale_limit(F.lit("16"), F.lit(4))) == 4 and one(po.stored_scale_limit(F.lit(None).cast("string"), F.lit(4))) == 4
    assert one(po.stored_speed(F.lit("2.5|GPU"), F.lit("GPU"))) == 2.5 and one(po.stored_speed(F.lit("2.5|GPU"), F.lit("other"))) is None


def test_colours(spark):
    cases = [((0, 0, 0), 7), ((255, 255, 255), 7), ((255, 0, 0), 1), ((0, 0, 255), 5), ((0, 200, 0), 3), ((128, 128, 128), 8), ((255, 128, 0), 30)]
    df = spark.createDataFrame([c for c, _ in cases], "r int, g int, b int").select(shapes.nearest_colour(F.col("r"), F.col("g"), F.col("b")))
    assert [r[0] for r in df.collect()] == [i for _, i in cases]


def test_clip(spark):
    cases = [((-50, 50, 250, 50), (0, 50, 200, 50)), ((50, -50, 50, 150), (50, 0, 50, 100)), ((10, 10, 20, 30), (10, 10, 20, 30)), ((300, 300, 400, 400), None)]
    rect = tuple(F.lit(float(v)) for v in (0, 0, 200, 100))
    df = spark.createDataFrame([tuple(map(float, c)) for c, _ in cases], "a double, b double, c double, d double").select(g.clip_segment(*map(F.col, "abcd"), rect))
    assert [r[0] and tuple(r[0]) for r in df.collect()] == [w and tuple(map(float, w)) for _, w in cases]


def test_arc_and_flatness(spark):
    k = 0.5522847498307936
    pts = [(F.lit(1.0), F.lit(0.0)), (F.lit(1.0), F.lit(k)), (F.lit(k), F.lit(1.0)), (F.lit(0.0), F.lit(1.0))]
    arc = spark.range(1).select(g.fit_arc(pts)).first()[0]
    assert arc["cx"] == pytest.approx(0, abs=1e-3) and arc["r"] == pytest.approx(1, abs=1e-3)
    line = [(F.lit(float(v)), F.lit(0.0)) for v in (0, 1, 2, 3)]
    assert spark.range(1).select(g.is_flat(line)).first()[0] and spark.range(1).select(g.fit_arc(line)).first()[0] is None


def test_spline(spark):
    assert spark.range(1).select(g.spline_knots(F.lit(4))).first()[0] == [0] * 4 + [1] * 3 + [2] * 3 + [3] * 3 + [4] * 4


def test_arc_fold_makes_one_arc(spark):
    arcs = F.array(*[F.struct(F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(1.0).alias("r"), F.lit(a).alias("a0"), F.lit(a + 1.0).alias("a1")) for a in (0.0, 1.0, 2.0)])
    out = spark.range(1).select(g.join_arcs(arcs)).first()[0]
    assert len(out) == 1 and (out[0]["a0"], out[0]["a1"]) == (0.0, 3.0)


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 3 * 16 + 7])
def test_chunk_manifest(spark, n):
    import hashlib

    body = bytes(range(256))[:n]
    df = spark.createDataFrame([(1, bytearray(body))], "id int, c binary")
    rows = hashing.chunk_manifest(df, "id", "c", 16).orderBy("chunk_no").collect()
    assert [r["sha256"] for r in rows] == [hashlib.sha256(body[k : k + 16]).hexdigest() for k in range(0, n, 16)]
    f = hashing.file_manifest(df, "id", "c", 16).first()
    assert (f["length"], f["chunk_count"], f["sha256"]) == (n, -(-n // 16), hashlib.sha256(body).hexdigest())


def test_verification(spark):
    body = bytearray(range(64))
    flipped = bytearray(body)
    flipped[2 * 16 + 5] ^= 1
    rows = [(1, body, body), (2, body, flipped), (3, body, body[:16])]
    out = {r["id"]: (r["failure"], r["chunk_no"]) for r in hashing.verify_chunks(spark.createDataFrame(rows, "id int, a binary, b binary"), "id", "a", "b", 16).collect()}
    assert out == {1: (None, None), 2: ("ChunkMismatch", 3), 3: ("LengthMismatch", None)}


def test_registry_order_and_replacement(spark):
    conv = spark.createDataFrame([(0, "a", False, "missing"), (1, "b", True, None)], "ord int, name string, available boolean, reason string")
    edges = spark.createDataFrame([(0, ".docx", ".pdf", 0), (0, ".docx", ".odt", 1), (1, ".docx", ".odt", 2), (1, ".docx", ".md", 3), (1, ".png", ".png", 4)], "ord int, source string, target string, pos int")
    rows = registry.target_options(conv, edges).orderBy("source", "position").collect()
    assert [(r["target"], r["enabled"], r["reason"]) for r in rows] == [(".pdf", False, "missing"), (".odt", True, None), (".md", True, None)]
    asked = spark.createDataFrame([(".docx", ".pdf"), (".docx", ".odt")], "source string, target string")
    assert {r["target"]: r["converter"] for r in registry.find_converter(asked, conv, edges).collect()} == {".pdf": None, ".odt": "b"}


def test_drawings(spark, tmp_path):
    body = "  9\n$ACADVER\n  1\nAC1006\n  0\nLINE\n"
    (tmp_path / "a.dxf").write_text(body)
    rows = drawing.read_drawings(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["code"], r["value"]) for r in rows] == [("9", "$ACADVER"), ("1", "AC1009"), ("0", "LINE")]
    versions = ["AC1006", "AC1009", "AC1012", "AC1014", "AC1018", "AC1021", "AC1032"]
    got = spark.createDataFrame([(v,) for v in versions], "v string").select(drawing.writable_version(F.col("v"), ".dwg")).collect()
    assert [r[0] for r in got] == ["AC1015", "AC1015", "AC1015", "AC1014", "AC1018", "AC1024", "AC1032"]
    assert scan.scan(spark, str(tmp_path), "*.dxf").count() == 1


def test_office_packages(spark):
    pages = spark.createDataFrame([(i, "u") for i in range(30)], "page_id long, url string")
    out = {r["page_id"]: r["problem"] for r in validate.office_check(validate.sample_packages(pages), "page_id", "ext", "content").collect()}
    want = {0: None, 1: "no main part", 2: "wrong root", 3: "damaged", 4: "damaged"}
    assert out == {i: want[i % 5] for i in range(30)}
