"""Signature tables: built-in list, JSON reader and writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefield.functions.bytesops import hex_bytes

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30

# fixed values: name, extension, hex header, hex footer, max size, footer search offset
DEFAULT_SIGNATURES = [
    ("JPEG Image", ".jpg", "FFD8FF", "FFD9", 10 * MIB, 1024),
    ("PNG Image", ".png", "89504E470D0A1A0A", "49454E44AE426082", 50 * MIB, 2048),
    ("GIF Image", ".gif", "474946383761", "003B", 10 * MIB, 1024),
    ("BMP Image", ".bmp", "424D", "", 100 * MIB, 0),
    ("TIFF Image", ".tiff", "49492A00", "", 100 * MIB, 0),
    ("TIFF Image BE", ".tiff", "4D4D002A", "", 100 * MIB, 0),
    ("WebP Image", ".webp", "52494646", "", 50 * MIB, 0),
    ("Canon CR2 RAW", ".cr2", "49492A00100000004352", "", 100 * MIB, 0),
    ("Nikon NEF RAW", ".nef", "4D4D002A", "", 100 * MIB, 0),
    ("Sony ARW RAW", ".arw", "49492A00", "", 100 * MIB, 0),
    ("PDF Document", ".pdf", "255044462D", "0A2525454F46", 100 * MIB, 4096),
    ("Microsoft Word Document", ".docx", "504B030414000600", "504B0506", 50 * MIB, 4096),
    ("Microsoft Word Legacy", ".doc", "D0CF11E0A1B11AE1", "", 50 * MIB, 0),
    ("Microsoft Excel", ".xlsx", "504B030414000600", "504B0506", 50 * MIB, 4096),
    ("Microsoft Excel Legacy", ".xls", "D0CF11E0A1B11AE1", "", 50 * MIB, 0),
    ("Microsoft PowerPoint", ".pptx", "504B030414000600", "504B0506", 100 * MIB, 4096),
    ("Microsoft PowerPoint Legacy", ".ppt", "D0CF11E0A1B11AE1", "", 100 * MIB, 0),
    ("RTF Document", ".rtf", "7B5C727466", "7D", 50 * MIB, 1024),
    ("OpenDocument Text", ".odt", "504B030414000600", "504B0506", 50 * MIB, 4096),
    ("ZIP Archive", ".zip", "504B0304", "504B0506", GIB, 8192),
    ("RAR Archive", ".rar", "526172211A0700", "", GIB, 0),
    ("7-Zip Archive", ".7z", "377ABCAF271C", "", GIB, 0),
    ("GZIP Archive", ".gz", "1F8B08", "", GIB, 0),
    ("TAR Archive", ".tar", "7573746172", "", GIB, 0),
    ("MP4 Video", ".mp4", "000000186674797033677034", "", 4 * GIB, 0),
    ("Canon MOV Video", ".mov", "0000001466747970717420", "", 4 * GIB, 0),
    ("AVI Video", ".avi", "52494646", "", 4 * GIB, 0),
    ("MKV Video", ".mkv", "1A45DFA3", "", 4 * GIB, 0),
    ("FLV Video", ".flv", "464C5601", "", GIB, 0),
    ("WMV Video", ".wmv", "3026B2758E66CF11", "", 2 * GIB, 0),
    ("MP3 Audio", ".mp3", "494433", "", 100 * MIB, 0),
    ("MP3 Audio (Frame)", ".mp3", "FFFB", "", 100 * MIB, 0),
    ("WAV Audio", ".wav", "52494646", "", GIB, 0),
    ("FLAC Audio", ".flac", "664C6143", "", GIB, 0),
    ("AAC Audio", ".aac", "FFF1", "", 100 * MIB, 0),
    ("OGG Audio", ".ogg", "4F676753", "", 100 * MIB, 0),
    ("SQLite Database", ".db", "53514C69746520666F726D6174203300", "", GIB, 0),
    ("MySQL Database", ".mdb", "0000000000000000", "", 2 * GIB, 0),
    ("Access Database", ".mdb", "5374616E64617264204A6574204442", "", 2 * GIB, 0),
    ("PostgreSQL Database", ".pgdata", "5047444D50", "", GIB, 0),
    ("Windows Executable", ".exe", "4D5A", "", 100 * MIB, 0),
    ("DLL Library", ".dll", "4D5A", "", 50 * MIB, 0),
    ("ELF Executable", ".elf", "7F454C46", "", 100 * MIB, 0),
    ("Mach-O Executable", ".macho", "FEEDFACE", "", 100 * MIB, 0),
    ("CAB Archive", ".cab", "4D534346", "", GIB, 0),
    ("MSI Installer", ".msi", "D0CF11E0A1B11AE1", "", GIB, 0),
    ("ISO Image", ".iso", "4344303031", "", 4 * GIB, 0),
    ("DMG Image", ".dmg", "78017A444D47", "", 4 * GIB, 0),
    ("VHD Image", ".vhd", "636F6E6563746978", "", 4 * GIB, 0),
    ("VMDK Image", ".vmdk", "4B444D56", "", 4 * GIB, 0),
    ("Email MSG", ".msg", "D0CF11E0A1B11AE1", "", 50 * MIB, 0),
    ("Email EML", ".eml", "46726F6D3A", "", 50 * MIB, 0),
    ("PST Archive", ".pst", "2142444E", "", 2 * GIB, 0),
    ("Registry Hive", ".reg", "72656766", "", 100 * MIB, 0),
    ("Event Log", ".evt", "300000004C664C65", "", 100 * MIB, 0),
    ("Prefetch File", ".pf", "11000000534341434100000000000000", "", MIB, 0),
    ("LNK Shortcut", ".lnk", "4C00000001140200", "", MIB, 0),
    ("Java Class", ".class", "CAFEBABE", "", 10 * MIB, 0),
    ("Android APK", ".apk", "504B030414000600", "504B0506", GIB, 8192),
    ("Windows Font", ".ttf", "0001000000", "", 10 * MIB, 0),
    ("OpenType Font", ".otf", "4F54544F", "", 10 * MIB, 0),
    ("Web Font", ".woff", "774F4646", "", 10 * MIB, 0),
    ("ICO Icon", ".ico", "00000100", "", MIB, 0),
]

CATEGORY_OF = {
    "image": "Image RAW Icon", "video": "Video", "audio": "Audio",
    "document": "Document Word Excel PowerPoint OpenDocument Email", "archive": "Archive",
    "executable": "Executable Library Installer Class", "database": "Database", "font": "Font",
}
RAW_SCHEMA = (
    "name string, extension string, header string, footer string, max_size bigint, "
    "footer_search_offset bigint, description string"
)


def _typed(df: DataFrame) -> DataFrame:
    """Hex text to bytes; an empty footer means none."""
    return df.select(
        "name",
        "extension",
        hex_bytes(F.col("header")).alias("header"),
        hex_bytes(F.col("footer")).alias("footer"),
        "max_size",
        F.coalesce("footer_search_offset", F.lit(0)).cast("bigint").alias("footer_search_offset"),
    ).filter("header is not null")


def category(name) -> object:
    chain = None
    for kind, tokens in CATEGORY_OF.items():
        cond = name.rlike("|".join(tokens.split()))
        chain = F.when(cond, kind) if chain is None else chain.when(cond, kind)
    return chain.otherwise("other")


def default_signatures(spark: SparkSession, categories: list[str] | None = None) -> DataFrame:
    raw = spark.createDataFrame(
        DEFAULT_SIGNATURES,
        "name string, extension string, header string, footer string, max_size bigint, footer_search_offset bigint",
    )
    out = _typed(raw).withColumn("category", category(F.col("name")))
    return out if categories is None else out.filter(F.col("category").isin(*categories))


def signatures_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows shaped like ``DEFAULT_SIGNATURES``."""
    return _typed(spark.createDataFrame(
        rows, "name string, extension string, header string, footer string, max_size bigint, footer_search_offset bigint"
    ))


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """JSON ``{"signatures": [...]}``; what cannot be parsed yields no rows."""
    doc = spark.read.schema(f"signatures array<struct<{RAW_SCHEMA.replace(' ', ':').replace(',:', ',')}>>").json(
        path, multiLine=True, mode="PERMISSIVE"
    )
    return _typed(doc.select(F.inline(F.filter("signatures", lambda x: x.isNotNull()))))


def write_signatures(signatures: DataFrame, path: str) -> None:
    """One JSON document with version and generator, a signature a line: the list streams into it, sorted, and is in no one cell."""
    entry = F.to_json(
        F.struct(
            "name", "extension", F.hex("header").alias("header"), F.coalesce(F.hex("footer"), F.lit("")).alias("footer"), "max_size", "footer_search_offset",
        )
    )
    spark = signatures.sparkSession
    edges = spark.createDataFrame([(0, '{"version": "1.0", "generator": "tracefield", "signatures": [null'), (2, "]}")], "part int, value string")
    # every entry brings the comma before it; the list begins with a null, which readers pass over
    lines = edges.unionByName(signatures.select(F.lit(1).alias("part"), F.concat(F.lit(","), entry).alias("value")))
    lines.orderBy("part", "value").select("value").coalesce(1).write.mode("overwrite").text(path)
