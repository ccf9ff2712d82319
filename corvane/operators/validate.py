"""Checks of written files: office packages, compound files, rich text."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extension -> (main part, root element, content of the mimetype entry).
PACKAGES = {
    ".docx": ("word/document.xml", "document", None),
    ".xlsx": ("xl/workbook.xml", "workbook", None),
    ".pptx": ("ppt/presentation.xml", "presentation", None),
    ".odt": ("content.xml", "document-content", "application/vnd.oasis.opendocument.text"),
    ".ods": ("content.xml", "document-content", "application/vnd.oasis.opendocument.spreadsheet"),
    ".odp": ("content.xml", "document-content", "application/vnd.oasis.opendocument.presentation"),
}


def compound_ok(content: Column) -> Column:
    return (F.hex(F.substring(content, F.lit(1), F.lit(8))) == "D0CF11E0A1B11AE1") & (F.octet_length(content) >= 1536)


def rtf_ok(text: Column) -> Column:
    return text.startswith("{\\rtf") & F.regexp_replace(text, "[\r\n \u0000]+$", "").endswith("}")


class _Refused(Exception):
    pass


def root_name(xml: bytes) -> str | None:
    """The local name of the root of a part that is parsed to its end; document types are refused."""
    seen: list[str] = []
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.StartElementHandler = lambda name, _: seen or seen.append(name.rpartition(" ")[2])

    def refuse(*_):
        raise _Refused

    parser.StartDoctypeDeclHandler = refuse
    parser.Parse(xml, True)
    return seen[0] if seen else None


def package_problem(content: bytes, ext: str) -> str | None:
    """What is wrong with an office package, or None."""
    part, root, mimetype = PACKAGES[ext]
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            if mimetype is None and "[Content_Types].xml" not in names:
                return "no content types"
            if mimetype is not None and ("mimetype" not in names or z.read("mimetype").decode("ascii", "replace") != mimetype):
                return "wrong type"
            if part not in names:
                return "no main part"
            return None if root_name(z.read(part)) == root else "wrong root"
    except (zipfile.BadZipFile, expat.ExpatError, _Refused, EOFError, OSError, ValueError, NotImplementedError, RuntimeError):
        return "damaged"


def office_check(files: DataFrame, key: str, ext: str, content: str) -> DataFrame:
    """(key, problem). A ZIP directory has no SQL form, so packages go through Arrow batches, each file on its own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "problem": [package_problem(bytes(c), e) for c, e in zip(f[content], f[ext], strict=True)]})

    return files.select(key, ext, content).mapInPandas(run, f"{key} long, problem string")


def sample_packages(pages: DataFrame) -> DataFrame:
    """(page_id, ext, content): small packages made of pages, some of them damaged in known ways."""
    exts = list(PACKAGES)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, url in zip(f["page_id"], f["url"], strict=True):
                ext = exts[i % len(exts)]
                part, root, mimetype = PACKAGES[ext]
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as z:
                    z.writestr("mimetype" if mimetype else "[Content_Types].xml", mimetype or "<Types/>")
                    if i % 5 != 1:
                        z.writestr(part, f"<x:{root if i % 5 != 2 else 'other'} xmlns:x='urn:x'><a>{len(url)}</a></x:{root if i % 5 != 2 else 'other'}>"[: None if i % 5 != 3 else 20])
                content = buffer.getvalue()
                rows.append((i, ext, content[: len(content) // 2] if i % 5 == 4 else content))
            yield pd.DataFrame(rows, columns=["page_id", "ext", "content"])

    return pages.select("page_id", "url").mapInPandas(run, "page_id long, ext string, content binary")
