"""File type tests on magic bytes, as CASE chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefield.functions import fixed_values as fv
from tracefield.functions.bytesops import magic


def _has(data: Column, token: bytes) -> Column:
    return F.contains(data, F.unhex(F.lit(token.hex())))


def detect_type(data: Column) -> Column:
    """First matching signature in list order; the ZIP family is told apart by its first 30 bytes."""
    head = F.substring(data, 1, 30)
    long = F.octet_length(data) > 30
    zip_kind = (
        F.when(long & _has(head, b"word/"), "DOCX")
        .when(long & _has(head, b"xl/"), "XLSX")
        .when(long & _has(head, b"ppt/"), "PPTX")
        .otherwise("ZIP")
    )
    chain = None
    for sig, off, kind in fv.TYPE_SIGNATURES:
        value = zip_kind if kind in ("ZIP", "DOCX") else F.lit(kind)
        cond = magic(data, sig, off)
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    return chain.otherwise("UNKNOWN")


def magic_type(data: Column) -> Column:
    return (
        F.when(magic(data, "FFD8"), "jpeg")
        .when(magic(data, "89504E470D0A1A0A"), "png")
        .when(magic(data, "25504446"), "pdf")
        .when(magic(data, "4D5A"), "executable")
        .otherwise("unknown")
    )


def container_type(data: Column) -> Column:
    """WebM is looked for before its parent format, so that it can be found."""
    brand = F.substring(data, 9, 4)
    qt = (brand == F.lit(b"qt  ")) | (brand == F.lit(b"mov "))
    ebml = magic(data, "1A45DFA3")
    return (
        F.when(F.octet_length(data) < 8, "UNKNOWN")
        .when(magic(data, b"ftyp".hex(), 4) & qt, "MOV")
        .when(magic(data, b"ftyp".hex(), 4), "MP4")
        .when(magic(data, b"RIFF".hex()) & magic(data, b"AVI ".hex(), 8), "AVI")
        .when(ebml & _has(F.substring(data, 1, 100), b"webm"), "WEBM")
        .when(ebml, "MKV")
        .when(magic(data, b"FLV".hex()), "FLV")
        .otherwise("UNKNOWN")
    )


def detect_codec(data: Column) -> Column:
    """First listed codec marker contained in the first KiB (a header test)."""
    head = F.substring(data, 1, 1024)
    return F.coalesce(*[F.when(F.contains(head, F.unhex(F.lit(h))), F.lit(n)) for n, h in fv.CODEC_SIGNATURES])


def format_by_content(data: Column) -> Column:
    """First video format whose magic stands at its own offset; the file must go on after it."""
    tests = [
        F.when((F.octet_length(data) > off + len(sig) // 2) & magic(data, sig, off), F.lit(ext))
        for ext, sig, off, _ in fv.VIDEO_FORMATS
        if sig
    ]
    return F.coalesce(*tests)


def validate_format(ext: Column, data: Column) -> Column:
    known = F.lit(False)
    mismatch = F.lit(False)
    for e, sig, off, _ in fv.VIDEO_FORMATS:
        known = known | (ext == e)
        if sig:
            mismatch = mismatch | ((ext == e) & ~magic(data, sig, off))
    return (
        F.when(data.isNull(), "missing")
        .when(F.octet_length(data) == 0, "empty")
        .when(~known & format_by_content(data).isNull(), "unrecognised")
        .when(mismatch, "signature mismatch")
        .otherwise("valid")
    )


def is_binary(data: Column) -> Column:
    return F.contains(F.substring(data, 1, 1024), F.unhex(F.lit("00")))


def recovered_errors(ext: Column, data: Column) -> Column:
    """Array of error codes of a recovered file; an empty array means valid."""
    size = F.octet_length(data)
    jpeg = ext.isin("jpg", "jpeg")
    codes = F.array(
        F.when(data.isNull(), "missing"),
        F.when(size == 0, "empty"),
        F.when(jpeg & ~magic(data, "FFD8FF"), "jpeg header"),
        F.when(jpeg & (F.substring(data, -2, 2) != F.unhex(F.lit("FFD9"))), "jpeg footer"),
        F.when((ext == "png") & ~magic(data, "89504E470D0A1A0A"), "png header"),
        F.when((ext == "pdf") & ~magic(data, b"%PDF-".hex()), "pdf header"),
        F.when((ext == "zip") & ~magic(data, "504B0304"), "zip header"),
    )
    return F.filter(codes, lambda c: c.isNotNull())


MIME_BY_EXTENSION = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp",
    "pdf": "application/pdf", "doc": "application/msword", "zip": "application/zip", "exe": "application/octet-stream",
    "mov": "video/quicktime", "mp4": "video/mp4", "avi": "video/x-msvideo", "mkv": "video/x-matroska",
    "flv": "video/x-flv", "wmv": "video/x-ms-wmv", "mpg": "video/mpeg", "mp3": "audio/mpeg", "txt": "text/plain",
}


def mime_of(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME_BY_EXTENSION.items() for x in kv])
    return F.try_element_at(table, F.lower(ext))


def mp4_issues(data: Column) -> Column:
    """Required tokens missing anywhere in the file."""
    codes = F.array(
        F.when(F.octet_length(data) == 0, "empty"),
        *[
            F.when((F.octet_length(data) > 0) & ~_has(data, a), F.lit(f"missing {a.decode()}"))
            for a in (b"ftyp", b"moov")
        ],
    )
    return F.filter(codes, lambda c: c.isNotNull())


def avi_issues(data: Column) -> Column:
    head = F.substring(data, 1, 12)
    codes = F.array(
        F.when(F.octet_length(data) == 0, "empty"),
        F.when((F.octet_length(data) > 0) & ~magic(data, b"RIFF".hex()), "missing RIFF header"),
        F.when((F.octet_length(data) > 0) & ~_has(head, b"AVI "), "missing AVI identifier"),
    )
    return F.filter(codes, lambda c: c.isNotNull())


def repair_priority(ext: Column) -> Column:
    """``ext`` with its dot."""
    known = [e for e, *_ in fv.VIDEO_FORMATS]
    pro = [e for e, _, _, p in fv.VIDEO_FORMATS if p]
    return (
        F.when(ext.isNull() | ~ext.isin(*known), 1)
        .when(ext.isin(*pro), 8)
        .when(ext.isin(".mp4", ".mov", ".mkv"), 7)
        .when(ext.isin(".avi", ".wmv", ".flv"), 5)
        .otherwise(3)
    )


def frame_corrupt(zero_share: Column, edge_density: Column, stddev: Column, edge_limit: float = 0.005) -> Column:
    return (zero_share > 0.5) | (edge_density < edge_limit) | (stddev < 5)
