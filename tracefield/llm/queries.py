"""Registered queries of this folder, each over its whole table, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefield.llm import cover_tree, decontaminate, language, lexical, merkle, minhash, packing, pii, quality, token_files, toxicity, url_filter, warc
from tracefield.llm.common import table

# fixed values: the given url rules (host, path, action)
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.learn(docs))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of the labels: 0 low quality, 1 good but toxic, 2 good."""
    docs = table(spark, sf_dir, "documents")
    rated = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    model = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", rated.alias("grade")))
    tails = F.col("tails")
    return quality.grade_texts(docs, model).select("doc_id", "expected_grade", F.get(tails, 0).alias("p_good"), F.get(tails, 1).alias("p_good_clean"), "selected")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), token_files.token_folder(spark), tokenizer_path("word_bpe_49k.json"))
    return token_files.read_token_files(manifest)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, language.load_pieces(tokenizer_path("piece_bpe_32k.model")))
    return language.identify(docs, model)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no capture time: seconds after the start of 2020, by page_id."""
    captured = F.timestamp_seconds(F.lit(1_577_836_800) + F.pmod("page_id", F.lit(1_000_000_000)))
    index = warc.merged_index(warc.write_archives(table(spark, sf_dir, "pages"), warc.capture_folder(spark), captured))
    return index.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = """
with parts as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), cut as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts
), judged as (
  select *, case
    when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule from cut
)
select page_id, host, path, rule, case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict from judged
"""

OP11_SQL = r"""
with recursive bits as (
  select i, list_reduce(list_prepend(i, range(8)), lambda c, r: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end)) as v from range(256) t(i)
), crc_table as (
  select list(v order by i) as entries from bits
), hashed as (
  select doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint)),
    lambda c, b: xor(c >> 8, entries[1 + (xor(c, b) & 255)]))) as crc from (select distinct doc_id from documents where doc_id is not null), crc_table
), rows as (
  select row_number() over () as id, d.*, coalesce(crc % 5 = 0, false) as hit, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low
  from documents d left join hashed using (doc_id)
), told as (
  select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head from rows
), leaves as (
  select id, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    sha256(head || case when hit then coalesce(strlen(low) || ':' || low, '-') else coalesce(strlen(text) || ':' || text, '-') end) as other from told
), numbered as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as number from leaves
), tree as (
  select 0 as level, source, number as n, leaf as h, count(*) over (partition by source) as size from numbered
  union all
  select level + 1, source, n // 16, sha256(string_agg(h, '' order by n)), max(size + 15) // 16 from tree where size > 1 group by level, source, n // 16
), subroots as (
  select source, h as subroot, row_number() over (order by source nulls first) - 1 as n, count(*) over () as size from tree where size = 1
), top as (
  select 0 as level, n, subroot as h, size from subroots
  union all
  select level + 1, n // 16, sha256(string_agg(h, '' order by n)), max(size + 15) // 16 from top where size > 1 group by level, n // 16
), inner_levels as (
  select source, level, n, string_agg(h, '' order by n) over (w rows between unbounded preceding and 1 preceding) as l,
    string_agg(h, '' order by n) over (w rows between 1 following and unbounded following) as r
  from tree where size > 1 window w as (partition by source, level, n // 16 order by n)
), top_levels as (
  select level, n, string_agg(h, '' order by n) over (w rows between unbounded preceding and 1 preceding) as l,
    string_agg(h, '' order by n) over (w rows between 1 following and unbounded following) as r
  from top where size > 1 window w as (partition by level, n // 16 order by n)
), path as (
  select id, level, coalesce(l, '') as l, coalesce(r, '') as r from numbered join inner_levels i on i.source is not distinct from numbered.source and i.n = numbered.number // (16 ** i.level)::bigint
  union all
  select id, 1000 + level, coalesce(l, ''), coalesce(r, '') from numbered join subroots s on s.source is not distinct from numbered.source
    join top_levels t on t.n = s.n // (16 ** t.level)::bigint
), steps as (
  select id, list(struct_pack(l, r) order by level) as s, string_agg(l || r, '' order by level) as siblings from path group by id
), folded as (
  select id, 1 as k, other as h from numbered
  union all
  select f.id, k + 1, sha256(s[k].l || h || s[k].r) from folded f join steps using (id) where k <= len(s)
), ends as (
  select id, arg_max(h, k) as folded_root from folded group by id
)
select doc_id, leaf, subroot, h as root, sha256(coalesce(siblings, '')) as proof_sha256, folded_root, folded_root = h as verified
from numbered join ends using (id) left join steps using (id) join subroots s on s.source is not distinct from numbered.source join (select h from top where size = 1) on true
"""

OP12_SQL = r"""
with digested as (
  select page_id, coalesce(strlen(html), 0) as payload_bytes, sha1(coalesce(html, '')) as h from pages
), spelt as (
  select *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 10 * (i // 8)::int, 10))::bigint >> (35 - 5 * (i % 8)::int)) & 31)::int, 1)), '') as payload_digest,
    max(page_id) over (partition by h) as best from digested
)
select page_id, payload_bytes, payload_digest, case when page_id < best or (page_id is null and best is not null) then 'revisit' else 'response' end as record_type,
  case when page_id < best or (page_id is null and best is not null) then best end as refers_to from spelt
"""

OP13_SQL = r"""
with terms as (
  select doc_id, d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as d, doc_id, text from documents)
), counts as (
  select d, any_value(doc_id) as doc_id, term, count(*) as tf from terms group by d, term
), sizes as (
  select d, sum(tf)::bigint as n from counts group by d
), whole as (
  select count(*) as docs, sum(n)::bigint as total from sizes
), asked as (
  select i, item_id, term, count(*) as times from (
    select row_number() over () as i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark)
  group by i, item_id, term
), weights as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from counts, whole where term in (select term from asked) group by term
), scored as (
  select i, item_id, d, any_value(doc_id) as doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::bigint as score
  from asked join weights using (term) join counts using (term) join sizes using (d), whole group by i, item_id, d
), ranked as (
  select *, row_number() over (partition by i order by score desc, doc_id nulls last) as rank from scored where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20
"""

QUERIES = {
    "op1_cover_tree": op1_cover_tree,
    "op2_pii": op2_pii,
    "op3_decontaminate": op3_decontaminate,
    "op4_minhash": op4_minhash,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_token_files": op7_token_files,
    "op8_url_filter": op8_url_filter,
    "op9_toxicity": op9_toxicity,
    "op10_language": op10_language,
    "op11_merkle": op11_merkle,
    "op12_warc": op12_warc,
    "op13_lexical": op13_lexical,
}
ORACLE = {"op8_url_filter": OP8_SQL, "op11_merkle": OP11_SQL, "op12_warc": OP12_SQL, "op13_lexical": OP13_SQL}
