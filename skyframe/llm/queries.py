"""The queries ``opN_<name>`` of these operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .chat import format_chats, masked_text, parse_chat
from .decontam import contamination
from .exact_dedup import exact_groups
from .id_coder import read_ids, write_ids
from .minhash_dedup import NearDupConfig, near_groups
from .packing import pack
from .token_fst import token_counts
from .store import Scratch
from .tokens import tokenizer_path
from .url_filter import UrlRule, judge_urls
from .warc import audit, copy_replica, write_warc

URL_RULES = (
    UrlRule("com/", "allow"),
    UrlRule("example.com/en/", "block"),
    UrlRule("www.example.com/en/", "allow"),
    UrlRule("net/es/", "block"),
    UrlRule("net/fr/", "block"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def planted_damage(page_id: Column) -> Column:
    """The records that the second replica of :func:`op2_warc_fixity` has damaged."""
    return F.pmod(F.crc32(F.encode(page_id.cast("string"), "utf-8")), F.lit(50)) == 0


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC, a second replica with planted damage, and its audit."""
    scratch = Scratch(spark, "warc")
    roots = scratch.path("replica-a"), scratch.path("replica-b")
    manifest = scratch.save(write_warc(table(spark, sf_dir, "pages"), roots[0]), "manifest")
    scratch.save(copy_replica(manifest, *roots, planted_damage(F.col("page_id"))), "copies")
    found = audit(manifest, roots, scratch)
    return found.select("page_id", "file", "place", "offset", "length", F.lower(F.hex("sha256")).alias("sha256"), "intact_a", "intact_b")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=1, size=2048, with_ids=False)
    return pieces.drop("ids")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as coded id files, and what is read back from these."""
    scratch = Scratch(spark, "ids")
    root = scratch.path("files")
    manifest = scratch.save(write_ids(table(spark, sf_dir, "documents"), root, tokenizer_path("word_bpe_49k.json"), end_id=2), "manifest")
    return read_ids(manifest, root)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), NearDupConfig(width=3, percent=85))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    formatted = format_chats(turns.unionByName(extra))
    back = formatted.select("conv_id", "formatted", parse_chat(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(told, "utf-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "utf-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", (toxicity.fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_warc_fixity, op3_exact_dedup, op4_packing, op5_token_ids, op6_decontaminate, op7_minhash_dedup, op8_chat_format, op9_token_counts, op10_toxicity)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_url_filter": f"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
), fits AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM fits
""",
    "op3_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
""",
    "op6_decontaminate": f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\x00-/:-`{{-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\x00-/:-`{{-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, w[i:i + 9] AS win, least(len(w), 10) AS span FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), spans AS (SELECT DISTINCT span FROM windows), places AS (
  SELECT doc_id, w[i:i + span - 1] AS win, i, span FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM d, spans WHERE len(w) >= span)
), found AS (
  SELECT doc_id, item_id, i, span FROM places JOIN windows USING (win, span)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + span)) AS p FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op7_minhash_dedup": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.size + y.size - common)
), reach AS (
  SELECT doc_id, doc_id AS seen FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.seen
)
SELECT doc_id, coalesce(any_value(size), 0) AS n_shingles, min(seen) AS component_id, doc_id = min(seen) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
""",
    "op8_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role AS begins,
    length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS text_n, length(role) + length(regexp_replace(role, '[^\\#<]', '', 'g')) AS role_n FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
  CAST(sum(text_n + CASE WHEN begins THEN 17 + role_n ELSE 5 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
""",
}
