"""Text evidence as column expressions and row-expanding frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefield.functions import fixed_values as fv

# white space as a text splitter sees it, ASCII and Unicode
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_SPACE = SPACE.replace("[", "[^", 1)
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def hits(text: Column, words: list[str]) -> Column:
    """How many of ``words`` occur in ``text`` at all."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(text, F.lit(w)).cast("int")
    return total


def any_of(text: Column, words: list[str]) -> Column:
    return hits(text, words) > 0


def count_char(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def keyword_moderation(df: DataFrame, text: str = "text", max_chars: int | None = None) -> DataFrame:
    """Category, severity and confidence from the number of keywords found."""
    body = F.col(text) if max_chars is None else F.substring(text, 1, max_chars)
    n = F.col("flagged")
    return (
        df.withColumn("flagged", hits(F.lower(body), fv.MODERATION_KEYWORDS))
        .withColumn("category", F.when(n > 3, "VIOLENCE").otherwise("SAFE"))
        .withColumn("severity", F.when(n > 3, "MEDIUM").otherwise("LOW"))
        .withColumn("confidence", F.when(n > 3, 0.7).when(n > 0, 0.8).otherwise(0.95))
        .withColumn("needs_review", n > 3)
    )


def text_type(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(any_of(low, fv.LOG_WORDS), "log_file")
        .when(any_of(low, fv.SQL_WORDS), "sql_file")
        .when((count_char(text, ",") > count_char(text, " ")) & F.contains(text, F.lit("\n")), "csv_data")
        .when(text.rlike("^" + SPACE + r"*[{\[]"), "json_data")
        .when(any_of(low, fv.HTML_WORDS), "html_file")
        .otherwise("plain_text")
    )


def words(text: Column) -> Column:
    """Words between white space; every such character is turned into a blank first,
    since splitting at one plain character needs no regular expression."""
    return F.filter(F.split(blanks(text), " "), lambda w: w != "")


def blanks(text: Column) -> Column:
    return F.translate(text, SPACE_CHARS, " " * len(SPACE_CHARS))


def text_stats(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    return (
        df.withColumn("_w", words(t))
        .withColumn("chars", F.length(t))
        .withColumn("words", F.size("_w"))
        .withColumn("lines", count_char(t, "\n") + 1)
        .withColumn(
            "paragraphs",
            F.size(F.filter(F.split(t, "\n\n", -1), lambda p: p.rlike(NON_SPACE))),
        )
        .withColumn("unique_words", F.size(F.array_distinct(F.transform("_w", F.lower))))
        .withColumn(
            "avg_word_length",
            F.when(F.size("_w") > 0, F.length(F.replace(blanks(t), F.lit(" "), F.lit(""))) / F.size("_w")).otherwise(0.0),
        )
        .drop("_w")
    )


def spans(text: Column, pattern: str) -> Column:
    """Array of (match, start, end): starts follow from the gaps between matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.expr("cast(array() as array<struct<match:string,start:int,end:int>>)")
    walked = F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g")),
        F.struct(F.lit(0).alias("pos"), empty.alias("out")),
        lambda acc, p: F.struct(
            (acc["pos"] + F.length(p["g"]) + F.length(p["m"])).alias("pos"),
            F.array_append(
                acc["out"],
                F.struct(
                    p["m"].alias("match"),
                    (acc["pos"] + F.length(p["g"])).alias("start"),
                    (acc["pos"] + F.length(p["g"]) + F.length(p["m"])).alias("end"),
                ),
            ).alias("out"),
        ),
    )
    return F.when(F.size(found) > 0, walked["out"]).otherwise(empty)


def entities(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per e-mail, phone number or IPv4-shaped token, with its place."""
    none = F.expr("cast(array() as array<struct<match:string,start:int,end:int>>)")

    def rows(kind, pattern, conf):
        found = spans(F.col(text), pattern)
        if kind == "EMAIL":  # the costly pattern runs only where it can match
            found = F.when(F.contains(text, F.lit("@")), found).otherwise(none)
        return F.transform(
            found,
            lambda s: F.struct(
                F.lit(kind).alias("entity_type"),
                s["match"].alias("entity"),
                s["start"].alias("start_pos"),
                s["end"].alias("end_pos"),
                F.lit(conf).alias("confidence"),
            ),
        )

    per_type = [rows(*p) for p in fv.ENTITY_PATTERNS]
    return df.select(key, F.inline(F.concat(*per_type)))


def entities_map(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    t = F.col(text)

    def found(pattern):
        return F.regexp_extract_all(t, F.lit(pattern), F.lit(0))

    return df.select(
        key,
        found(fv.MAP_EMAIL).alias("emails"),
        found(fv.MAP_URL).alias("urls"),
        found(fv.MAP_IP).alias("ip_addresses"),
        found(fv.MAP_PHONE).alias("phone_numbers"),
    )


def btc_valid(addr: Column) -> Column:
    return F.length(addr).between(26, 35) & addr.rlike(fv.BTC_CHARSET)


def eth_valid(addr: Column) -> Column:
    return addr.rlike(fv.ETH_PATTERN)


def wallet_addresses(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Address-shaped tokens that also pass the address checks."""
    token = F.col("address")
    return (
        df.select(key, F.explode(F.regexp_extract_all(text, F.lit(fv.WALLET_TOKEN), F.lit(0))).alias("address"))
        .withColumn("currency", F.when(eth_valid(token), "ETH").when(btc_valid(token), "BTC"))
        .filter("currency is not null")
    )


def suspicious_strings(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per (text, term) found, case ignored."""
    low = F.col("_low")
    terms = F.filter(
        F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in fv.SUSPICIOUS_TERMS]),
        lambda x: x.isNotNull(),
    )
    return df.select(key, F.lower(text).alias("_low")).select(key, F.explode(terms).alias("term"))


def key_material(df: DataFrame, key: str, data: str = "data", entropy: Column | None = None) -> DataFrame:
    """Key and container markers contained in the bytes; the entropy gate is optional."""
    if entropy is not None:
        df = df.filter(entropy > 7.5)
    found = F.filter(
        F.array(*[F.when(F.contains(F.col(data), F.unhex(F.lit(h))), F.lit(n)) for n, h in fv.KEY_MARKERS]),
        lambda x: x.isNotNull(),
    )
    return df.select(key, F.explode(found).alias("algorithm")).withColumn("confidence", F.lit(0.8))


def parse_tool_log(text: Column) -> Column:
    """MAP of the six fields a repair tool prints; absent fields are left out."""
    pairs = []
    for name, pattern in fv.TOOL_LOG_FIELDS:
        value = F.regexp_extract(text, "(?i)" + pattern, 1)
        pairs.append(F.when(value != "", F.struct(F.lit(name).alias("k"), value.alias("v"))))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull()))


def log_error_score(text: Column) -> Column:
    low = F.lower(text)
    n = F.lit(0)
    for w in fv.LOG_ERROR_WORDS:
        n = n + F.regexp_count(low, F.lit(w))
    return F.when(n == 0, 1.0).when(n <= 2, 0.8).when(n <= 5, 0.6).when(n <= 10, 0.4).otherwise(0.2)


def corruption_share(text: Column) -> Column:
    """A tenth per keyword present, at most 1."""
    return F.least(hits(F.lower(text), fv.CORRUPTION_WORDS) * F.lit(0.1), F.lit(1.0))


def error_frames(text: Column) -> Column:
    """Frame numbers of lines that mention both a frame and an error."""
    lines = F.filter(
        F.split(text, "\n"),
        lambda ln: F.contains(F.lower(ln), F.lit("frame=")) & F.contains(F.lower(ln), F.lit("error")),
    )
    return F.filter(
        F.transform(lines, lambda ln: F.regexp_extract(ln, r"frame=\s*(\d+)(?:\s|$)", 1).try_cast("bigint")),
        lambda n: n.isNotNull(),
    )
