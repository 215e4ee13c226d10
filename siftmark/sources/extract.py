"""Files to texts: archives are expanded and office formats read in Arrow batches; other bytes are decoded."""

import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.fixed import UNSUPPORTED
from . import encodings
from .shared import pieces

#: What broken, encrypted or odd archives and office files raise.
ERRORS = (zipfile.BadZipFile, zlib.error, OSError, RuntimeError, EOFError, LookupError, ValueError, TypeError, OverflowError, struct.error, ElementTree.ParseError)
MAX_DEPTH, MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL = 2, 200, 50 << 20, 100 << 20


def is_safe_member(name: str) -> bool:
    n = name.replace("\\", "/")
    return not n.startswith("/") and ".." not in n.split("/")


def members(path: str, data: bytes, depth: int = 0) -> Iterator[tuple[str, bytes, str | None]]:
    """(outer!inner, bytes, error) of an archive, nested ones included. A member that can't be read is a row with the error, and so is a broken archive; the others go on."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        infos = z.infolist()
    except ERRORS as e:
        yield path, b"", told(e)
        return
    with z:
        total = read = 0
        for info in infos:
            if info.is_dir():
                continue
            if read >= MAX_ENTRIES:
                return
            if not is_safe_member(info.filename) or info.file_size > MAX_ENTRY:
                continue
            total += info.file_size
            if total > MAX_TOTAL:
                return
            read += 1  # entries that are skipped above don't count
            name = f"{path}!{info.filename}"
            try:
                with z.open(info) as f:
                    inner = f.read(MAX_ENTRY + 1)
            except ERRORS as e:
                yield name, b"", told(e)
                continue
            if len(inner) > MAX_ENTRY:
                continue
            if not info.filename.lower().endswith(".zip"):
                yield name, inner, None
            elif depth + 1 < MAX_DEPTH:
                yield from members(name, inner, depth + 1)


def told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:300]


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def docx_root(data: bytes) -> ElementTree.Element:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return ElementTree.fromstring(z.read("word/document.xml"))


def docx(data: bytes) -> str:
    """Paragraphs, then the cells of tables, one a line."""
    root = docx_root(data)
    told = lambda e: "".join(t.text or "" for t in e.iter() if local(t.tag) == "t")
    cells = [c for t in root.iter() if local(t.tag) == "tbl" for c in t.iter() if local(c.tag) == "tc"]
    inside = {id(p) for c in cells for p in c.iter()}
    lines = [told(p) for p in root.iter() if local(p.tag) == "p" and id(p) not in inside]
    lines += ["\n".join(told(p) for p in c.iter() if local(p.tag) == "p") for c in cells]
    return "\n".join(filter(None, lines))


def docx_flat(data: bytes) -> str:
    """All character data, trimmed and joined by spaces: the text of a sample, where docx() is the text of a scanned file."""
    return " ".join(x for x in (t.strip() for t in docx_root(data).itertext()) if x)


def sheets(z: zipfile.ZipFile) -> list[str]:
    """A workbook's sheets in its own order, by its relations; by the numbers in their names where it has no such list."""
    names = set(z.namelist())
    number = lambda n: (int("0" + re.sub(r"\D", "", n.rpartition("/")[2])), n)
    if not {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        return sorted((x for x in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", x)), key=number)
    target = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    told = [next((v for k, v in s.items() if local(k) == "id"), None) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if local(s.tag) == "sheet"]
    paths = [target[i].lstrip("/") if target[i].startswith("/") else posixpath.normpath(f"xl/{target[i]}") for i in told if i in target]
    return [p for p in paths if p in names and "/worksheets/" in p]


def xlsx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter() if local(t.tag) == "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if local(s.tag) == "si"]
        rows = []
        for n in sheets(z):
            for row in (r for r in ElementTree.fromstring(z.read(n)).iter() if local(r.tag) == "row"):
                cells = []
                for c in (c for c in row if local(c.tag) == "c"):
                    v = "".join(t.text or "" for t in c.iter() if local(t.tag) in ("v", "t"))
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                if any(cells):
                    rows.append(" ".join(x for x in cells if x))
    return "\n".join(rows)


def pdf_visible(data: bytes) -> str:
    """Runs of printable characters, where no PDF reader is installed."""
    return " ".join(re.findall(r"[\x20-\x7e一-鿿]{3,}", data.decode("utf-8", "replace")))


def pdf_reader() -> Callable[[str, bytes], str] | None:
    """A reader of PDF text layers by the library that is installed, or None. An installed reader only: none is written here."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    return lambda name, data: "\n".join(filter(None, (page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)))


def extract(path: str, data: bytes, pdf=None, models: encodings.Models | None = None) -> tuple[str, str | None, str | None]:
    """(text, why there is none, error). pdf: a reader (name, bytes) -> text; None if there is no reader. models: of encodings."""
    suffix = posixpath.splitext(path.lower())[1]
    if suffix in UNSUPPORTED:
        return "", "unsupported_format", None
    text, error = "", None
    try:
        if suffix == ".docx":
            text = docx(data)
        elif suffix == ".xlsx":
            text = xlsx(data)
        elif suffix == ".pdf":
            text = pdf(path, data) if pdf else ""
        else:
            text, error = encodings.decoded(data, models)
    except Exception as e:  # noqa: BLE001  one file, or a user's reader, must not end a scan
        error = told(e)
    reason = None if text or suffix != ".pdf" else "pdf_text_empty" if pdf else "pdf_reader_missing"
    return text, reason, error


def repaired(data: bytes) -> str:
    """UTF-8; each byte that is none becomes a space."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace").replace("\ufffd", " ")


def clean(text: Column) -> Column:
    """Runs of white space and NULs become one space each, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(text, "\x00", " "), r"[\t\n\f\r\x20]+", " "))


def sample_text(name: str, data: bytes, pdf=None) -> tuple[str, str | None]:
    """(text before clean(), warning) of an uploaded sample. pdf: an optional reader (name, bytes) -> text, such as OCR."""
    suffix = posixpath.splitext(name.lower())[1]
    try:
        if suffix == ".docx":
            return docx_flat(data), None
        if suffix == ".xlsx":
            return xlsx(data), None
    except ERRORS as e:
        return "", f"extract_error: {told(e)}"
    if suffix != ".pdf":
        return repaired(data), None
    text = pdf(name, data) if pdf else ""
    return (text, None) if text else (pdf_visible(data), "pdf_fallback")


def sample_texts(samples: DataFrame, pdf=None) -> DataFrame:
    """samples (file_name, content, ...) with `text` and `extract_warning`; null content is empty."""
    kept = samples.drop("text", "extract_warning")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sample_text(n or "", x or b"", pdf) for n, x in zip(b.column(names.index("file_name")).to_pylist(), b.column(names.index("content")).to_pylist(), strict=True)]
            yield b.append_column("text", pa.array([t for t, _ in got], pa.string())).append_column("extract_warning", pa.array([w for _, w in got], pa.string()))

    added = [StructField(n, StringType()) for n in ("text", "extract_warning")]
    return kept.mapInArrow(run, StructType([*kept.schema, *added])).withColumn("text", clean(F.col("text")))


def strict_members(data: bytes, most: int = 200, most_entry: int = 20 << 20, most_total: int = 100 << 20) -> dict[str, bytes]:
    """The members of an uploaded archive; one that breaks a limit, is nested or has an unsafe name fails the whole. Of equal names the last stays."""
    out: dict[str, bytes] = {}
    total = 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = [x for x in z.infolist() if not x.is_dir()]
        if len(infos) > most:
            raise ValueError(f"over {most} files")
        for x in infos:
            total += x.file_size
            if not is_safe_member(x.filename) or not valid_name(x.filename):
                raise ValueError(f"unsafe name {x.filename}")
            if x.filename.lower().endswith(".zip"):
                raise ValueError(f"nested archive {x.filename}")
            if x.file_size > most_entry or total > most_total:
                raise ValueError(f"too large: {x.filename}")
            out[posixpath.normpath(x.filename.replace("\\", "/"))] = z.read(x)
    return out


def valid_name(name: str) -> bool:
    """Not blank, 255 characters at most, and neither absolute nor above its folder."""
    n = posixpath.normpath(name.strip().replace("\\", "/"))
    return bool(name.strip()) and len(name) <= 255 and n != "." and not n.startswith("/") and n.split("/")[0] != ".."


def upload_error(name: Column, size: Column, most: int = 50 << 20) -> Column:
    """Why a sample may not be uploaded, or null."""
    path = F.regexp_replace(F.trim(name), r"\\", "/")
    up = F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("d"), F.lit(False).alias("bad")), _step, lambda s: s.bad | (s.d == 0))
    bad = (F.length(F.trim(F.coalesce(name, F.lit("")))) == 0) | (F.length(name) > 255) | path.startswith("/") | up
    return F.when(bad, "bad_name").when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > most, "too_large")


def _step(state: Column, part: Column) -> Column:
    """Depth below the folder while a path is followed; a leading climb is bad, one later only goes back up."""
    depth = F.when(part == "..", state.d - 1).when(part.isin("", "."), state.d).otherwise(state.d + 1)
    return F.struct(depth.alias("d"), (state.bad | (depth < 0)).alias("bad"))


def ocr_text(reply) -> str:
    """The text of an OCR service's parsed JSON reply: `text`, else what `result`, else `data` holds."""
    def inner(v) -> str:
        if isinstance(v, str):
            return v
        if isinstance(v, list):
            return "\n".join(filter(None, map(inner, v)))
        if isinstance(v, dict):
            return next(filter(None, (inner(v.get(k)) for k in ("text", "content", "recognized_text", "ocr_text", "lines"))), "")
        return ""

    text = reply.get("text")
    found = text if isinstance(text, str) and text else inner(reply.get("result")) or inner(reply.get("data"))
    if not found:
        raise ValueError("no text in the reply")
    return found


def expand(files: DataFrame) -> DataFrame:
    """(path, content, error) with archives replaced by their members; null content is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (some for batch in batches for some in pieces(batch)):
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = members(path, data or b"") if path.lower().endswith(".zip") else [(path, data or b"", None)]
                for p, x, e in found:
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.string()), pa.array([x], pa.binary()), pa.array([e], pa.string())], ["path", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary, error string")


def file_texts(files: DataFrame, skip: str, pdf="installed", models: encodings.Models | None = None) -> DataFrame:
    """files (path, content, error, ...) with text, skip_reason and extract_error for content and error; rows where the boolean column `skip` holds are not read."""
    names = files.columns
    rest = [n for n in names if n not in ("content", "error")]
    kept = [*(f for f in files.schema if f.name in rest), *(StructField(n, StringType()) for n in ("text", "skip_reason", "extract_error"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (some for batch in batches for some in pieces(batch)):
            reader = pdf_reader() if pdf == "installed" else pdf
            got = [("", None, e) if k or e else extract(p, x or b"", reader, models) for p, x, e, k in zip(*(b.column(names.index(c)).to_pylist() for c in ("path", "content", "error", skip)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(n)) for n in rest), *(pa.array([g[i] for g in got], pa.string()) for i in range(3))], [*rest, "text", "skip_reason", "extract_error"])

    return files.mapInArrow(run, StructType(kept))


def texts(files: DataFrame, pdf="installed", models: encodings.Models | None = None) -> DataFrame:
    """(path, content) -> (path, text, skip_reason, extract_error); an archive becomes its members. Null content is empty."""
    return file_texts(expand(files).withColumn("known", F.lit(False)), "known", pdf, models).drop("known")


def read_files(spark, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
