"""Small dimension tables. They are fixed values: results depend on them entry by entry."""

from __future__ import annotations

# Drawing colours as (index, red, green, blue), in order of preference.
PALETTE = (
    (1, 255, 0, 0), (2, 255, 255, 0), (3, 0, 255, 0), (4, 0, 255, 255), (5, 0, 0, 255), (6, 255, 0, 255), (7, 0, 0, 0), (7, 255, 255, 255),
    (8, 128, 128, 128), (9, 192, 192, 192), (250, 51, 51, 51), (251, 91, 91, 91), (252, 132, 132, 132), (253, 173, 173, 173), (254, 214, 214, 214),
    (30, 255, 127, 0), (40, 255, 191, 0), (50, 191, 255, 0), (90, 0, 255, 127), (130, 0, 191, 255), (150, 0, 127, 255), (170, 63, 0, 255),
    (190, 127, 0, 255), (210, 191, 0, 255), (230, 255, 0, 191), (12, 165, 0, 0), (32, 165, 82, 0), (72, 82, 165, 0), (92, 0, 165, 82),
    (152, 0, 82, 165), (172, 41, 0, 165),
)

# Memory tiers as (gigabytes, most pixels of a result, None without bound).
RAM_TIERS = ((8, 2560 * 1440), (16, 3840 * 2160), (32, 7680 * 4320), (64, None))

# Bounds of the scale.
MIN_SCALE, MAX_SCALE, PRESETS = 1.5, 16.0, (2, 4, 8, 16)

# Document families as (sources, targets, import filter).
FAMILIES = (
    ((".docx", ".doc", ".odt", ".rtf", ".txt"), (".pdf", ".docx", ".doc", ".odt", ".rtf"), None),
    ((".xlsx", ".xls", ".ods"), (".pdf", ".xlsx", ".xls", ".ods"), None),
    ((".pptx", ".ppt", ".odp"), (".pdf", ".pptx", ".ppt", ".odp"), None),
    ((".dxf", ".dwg"), (".pdf",), None),
    ((".pdf",), (".docx", ".doc", ".odt"), "writer_pdf_import"),
    ((".pdf",), (".pptx", ".ppt", ".odp"), "impress_pdf_import"),
)

# File formats as (extension, label, kind of file, argument of the kind's text), in catalog order.
CATALOG = (
    (".jpg", "JPG", "Image", "JPEG"), (".jpeg", "JPEG", "Image", "JPEG"), (".png", "PNG", "Image", "PNG"), (".bmp", "BMP", "Image", "BMP"),
    (".gif", "GIF", "Image", "GIF"), (".tif", "TIFF", "Image", "TIFF"), (".tiff", "TIFF", "Image", "TIFF"), (".heic", "HEIC", "Image", "HEIC"),
    (".heif", "HEIF", "Image", "HEIF"), (".webp", "WebP", "Image", "WebP"), (".mp3", "MP3", "Audio", "MP3"), (".m4a", "M4A", "Audio", "M4A"),
    (".wav", "WAV", "Audio", "WAV"), (".wma", "WMA", "Audio", "WMA"), (".flac", "FLAC", "Audio", "FLAC"), (".mp4", "MP4", "Video", "MP4"),
    (".wmv", "WMV", "Video", "WMV"), (".pdf", "PDF", "Pdf", None), (".docx", "DOCX", "Word", None), (".doc", "DOC", "Word", None),
    (".odt", "ODT", "OpenDocumentText", None), (".rtf", "RTF", "Rtf", None), (".txt", "TXT", "PlainText", None), (".html", "HTML", "WebPage", None),
    (".htm", "HTML", "WebPage", None), (".md", "Markdown", "Markdown", None), (".xlsx", "XLSX", "Excel", None), (".xls", "XLS", "Excel", None),
    (".ods", "ODS", "OpenDocumentSheet", None), (".pptx", "PPTX", "PowerPoint", None), (".ppt", "PPT", "PowerPoint", None),
    (".odp", "ODP", "OpenDocumentPresentation", None), (".dxf", None, "Cad", "DXF"), (".dwg", None, "Cad", "DWG"),
)

# Display texts as (language, key, template); English is the neutral one.
STRINGS = (
    ("en", "Kind.Image", "{0} image"), ("en", "Kind.Audio", "{0} audio"), ("en", "Kind.Video", "{0} video"), ("en", "Kind.Pdf", "PDF document"),
    ("en", "Kind.Word", "Word document"), ("en", "Kind.OpenDocumentText", "OpenDocument text"), ("en", "Kind.Rtf", "RTF document"),
    ("en", "Kind.PlainText", "Plain text"), ("en", "Kind.WebPage", "Web page"), ("en", "Kind.Markdown", "Markdown document"),
    ("en", "Kind.Excel", "Excel spreadsheet"), ("en", "Kind.OpenDocumentSheet", "OpenDocument spreadsheet"),
    ("en", "Kind.PowerPoint", "PowerPoint presentation"), ("en", "Kind.OpenDocumentPresentation", "OpenDocument presentation"),
    ("en", "Kind.Cad", "{0} CAD drawing"), ("en", "Kind.Unknown", "{0} file"), ("en", "Time.JustNow", "Just now"), ("en", "Time.Today", "Today, {0}"),
    ("en", "Time.Yesterday", "Yesterday, {0}"), ("en", "Size.Bytes", "{0} bytes"), ("en", "Size.DecimalSeparator", "."),
    ("id", "Kind.Image", "Gambar {0}"), ("id", "Kind.Audio", "Audio {0}"), ("id", "Kind.Video", "Video {0}"), ("id", "Kind.Pdf", "Dokumen PDF"),
    ("id", "Kind.Word", "Dokumen Word"), ("id", "Kind.OpenDocumentText", "Dokumen OpenDocument"), ("id", "Kind.Rtf", "Dokumen RTF"),
    ("id", "Kind.PlainText", "Teks biasa"), ("id", "Kind.WebPage", "Halaman web"), ("id", "Kind.Markdown", "Dokumen Markdown"),
    ("id", "Kind.Excel", "Lembar kerja Excel"), ("id", "Kind.OpenDocumentSheet", "Lembar kerja OpenDocument"),
    ("id", "Kind.PowerPoint", "Presentasi PowerPoint"), ("id", "Kind.OpenDocumentPresentation", "Presentasi OpenDocument"),
    ("id", "Kind.Cad", "Gambar CAD {0}"), ("id", "Kind.Unknown", "File {0}"), ("id", "Time.JustNow", "Baru saja"), ("id", "Time.Today", "Hari ini, {0}"),
    ("id", "Time.Yesterday", "Kemarin, {0}"), ("id", "Size.Bytes", "{0} byte"), ("id", "Size.DecimalSeparator", ","),
)

# Month names by language.
MONTHS = {
    "en": ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"),
    "id": ("Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agu", "Sep", "Okt", "Nov", "Des"),
}

# Drawing file versions that can be written.
DWG_VERSIONS = ("AC1014", "AC1015", "AC1018", "AC1024", "AC1027", "AC1032")
DXF_VERSIONS = ("AC1012", "AC1014", "AC1015", "AC1018", "AC1021", "AC1024", "AC1027", "AC1032")

# Converters in registration order as (order, name, available, reason) and their (order, source, target) edges.
CONVERTERS = ((0, "picture", True, None), (1, "tracer", True, None), (2, "page", True, None), (3, "office", False, "not installed"), (4, "drawing", True, None))
_PICTURES = (".jpg", ".png", ".bmp", ".gif", ".tif")
EDGES = (
    *((0, s, t) for s in _PICTURES for t in _PICTURES),
    *((1, s, t) for s in _PICTURES for t in (".dxf", ".dwg")),
    *((2, ".pdf", t) for t in (".png", ".jpg", ".heic")),
    *((3, s, t) for family in FAMILIES for s in family[0] for t in family[1]),
    (4, ".dwg", ".dxf"), (4, ".dxf", ".dwg"), (4, ".dxf", ".pdf"),
)
VALIDATORS = (
    *((0, t) for t in (*_PICTURES, ".heic")), (1, ".pdf"), *((2, t) for t in (".docx", ".doc", ".odt", ".rtf", ".xlsx", ".xls", ".ods", ".pptx", ".ppt")), *((3, t) for t in (".dxf", ".dwg")),
)


def values_sql(rows, columns: str) -> str:
    """A table as a SQL VALUES list, for engines that share no DataFrames."""
    def one(v) -> str:
        return "NULL" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS {columns}"
