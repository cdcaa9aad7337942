"""Writes Word packages from paragraph lists: fixtures for the readers of `docx` and `convention`."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .docx import BATCH_BYTES, DC, M, W14, WP, W, arrow_batches

_SPACES = " ".join(f'xmlns:{k}="{v[1:-1]}"' for k, v in {"w": W, "m": M, "w14": W14, "wp": WP, "dc": DC}.items())
_REFUSED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def escaped(text: str) -> str:
    """Text as XML content; characters that XML cannot hold become the replacement character."""
    return _REFUSED.sub("�", text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#13;")


def paragraph(text: str, para_id: str | None = None, inner: str = "") -> str:
    name = f' w14:paraId="{para_id}"' if para_id else ""
    return f'<w:p{name}><w:r><w:t xml:space="preserve">{escaped(text)}</w:t></w:r>{inner}</w:p>'


def table(rows: list[list[str]], style: str | None = None, grid: bool = True) -> str:
    head = (f'<w:tblPr><w:tblStyle w:val="{style}"/></w:tblPr>' if style else "") + ("<w:tblGrid/>" if grid else "")
    return "<w:tbl>" + head + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>"


def part(root: str, inner: str, attributes: str = "") -> str:
    return f"<{root} {_SPACES}{attributes}>{inner}</{root}>"


def package(body: str, parts: dict[str, str] | None = None, types: bool = True) -> bytes:
    """A zip of the content types, the document part, and whatever other parts are given by name."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = {"[Content_Types].xml": "<Types/>"} if types else {}
        for name, content in {**names, "word/document.xml": part("w:document", f"<w:body>{body}</w:body>"), **(parts or {})}.items():
            z.writestr(zipfile.ZipInfo(name), content)  # a fixed date, so that equal input gives equal bytes
    return out.getvalue()


def write_packages(rows: DataFrame, build: Callable[[dict], bytes]) -> DataFrame:
    """(path, content) of the package that `build` makes of each row; `rows` has a string column path."""
    names = ["path", "content"]

    def table(paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents, held = [], [], 0
            for at in range(batch.num_rows):  # a row at a time, and packages of a few rows
                (row,) = batch.slice(at, 1).to_pylist()
                paths.append(row["path"])
                contents.append(build(row))
                held += len(contents[-1] or b"")
                if held > BATCH_BYTES:
                    yield table(paths, contents)
                    paths, contents, held = [], [], 0
            yield table(paths, contents)

    arrow_batches(rows.sparkSession)
    return rows.mapInArrow(run, "path string, content binary")
