"""The operators on the supplied tables, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from purchaselens.llm import (
    bitplanes, bpe, fm, iblt, langid, licenses, lines, middle, minhash, periods, repeats,
    shards, winnow,
)
from purchaselens.llm.common import read


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode(docs, path, decoded=True, keep_text=False).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.learned(docs.select("doc_id", "text", "lang"))
    return langid.identify(docs.select("doc_id", "text"), model, keep_text=False).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(read(spark, sf_dir, "documents")).select(
        "doc_id", "source", "text", "n_dropped"
    )


OP4 = f"""WITH {lines.sql()}
SELECT doc_id, source, text,
       CASE WHEN text IS NULL THEN 0
            ELSE len(string_split(old_text, chr(10))) - len(list_filter(
              string_split(old_text, chr(10)), lambda x: x = '' OR NOT list_contains(bad_lines, x))) END
         AS n_dropped
FROM (SELECT c.*, coalesce(b.bad_lines, []) AS bad_lines
      FROM cleaned c LEFT JOIN bad b ON c.source IS NOT DISTINCT FROM b.source)"""


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


# Words and windows as the operator has them; SQL joins every window of every document.
OP5 = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
  bi AS (SELECT item, w, least(10, len(w)) AS z FROM b WHERE len(w) > 0),
  bw AS (SELECT DISTINCT item, z, array_to_string(w[p : p + z - 1], ' ') AS t
         FROM (SELECT item, z, w, unnest(range(1, len(w) - z + 2)) AS p FROM bi)),
  zs AS (SELECT DISTINCT z FROM bw),
  dw AS (SELECT r, z, p, array_to_string(w[p : p + z - 1], ' ') AS t
         FROM (SELECT r, z, w, unnest(range(1, len(w) - z + 2)) AS p FROM d, zs WHERE len(w) >= z)),
  m AS (SELECT r, p, dw.z, item FROM dw JOIN bw ON dw.t = bw.t AND dw.z = bw.z),
  hit AS (SELECT r, count(*) AS n FROM (
            SELECT DISTINCT r, unnest(range(p, p + z)) AS q FROM (SELECT DISTINCT r, p, z FROM m)) GROUP BY r),
  its AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l
          FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, keep_text=False).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score", "notices",
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.edited_pairs(read(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(read(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    files = bitplanes.write(read(spark, sf_dir, "documents"), path)
    return bitplanes.documents(files).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fm.learned(docs, read(spark, sf_dir, "labels"))
    return fm.score(docs, machine, keep_text=False).select(
        "doc_id", fm.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return middle.restore(middle.transform(docs, keep_text=False)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"),
        F.sha2(F.encode("restored", "UTF-8"), 256).alias("restored_sha256"),
    )


OP11 = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  r AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
  c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
  p AS (SELECT *, substring(t, 1, a) AS x, substring(t, a + 1, b - a) AS y, substring(t, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y
              ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""


def planted_words() -> Column:
    """The words of a text, joined by a blank; in one document of ten those from word a on repeat
    the p words at a."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(h / 10)
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), 1, n - a)
    repeated = F.concat(F.slice(words, 1, a), again)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(repeated, " ")).otherwise(F.coalesce("text", F.lit("")))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", planted_words().alias("text"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    longest = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")
    )))
    found = periods.collapse(docs, keep_text=False).withColumn("longest", longest)
    length = -F.col("longest.less")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("longest.start").alias("start"),
        length.alias("length"), F.col("longest.period").alias("period"),
        F.floor(length * 1000 / F.col("longest.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


# Windows as text, whole; a doc_id on several rows removes nothing from itself.
OP13 = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  v AS (SELECT r, doc_id, p, array_to_string(w[p : p + 12], ' ') AS t
        FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
  f AS (SELECT t, min(doc_id) AS least FROM v GROUP BY t HAVING min(doc_id) < max(doc_id)),
  g AS (SELECT r, list(DISTINCT q) AS gone FROM (
          SELECT r, unnest(range(p, p + 13)) AS q FROM v JOIN f USING (t) WHERE doc_id > least) GROUP BY r),
  k AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS kept FROM (
          SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d JOIN g USING (r))
          ANTI JOIN (SELECT r, unnest(gone) AS p FROM g) USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN g USING (r) LEFT JOIN k USING (r)"""


QUERIES = {
    "op1_bpe": (op1_bpe, None),
    "op2_language": (op2_language, None),
    "op3_minhash": (op3_minhash, None),
    "op4_line_dedup": (op4_line_dedup, OP4),
    "op5_winnowing": (op5_winnowing, OP5),
    "op6_licenses": (op6_licenses, None),
    "op7_fingerprints": (op7_fingerprints, None),
    "op8_sharding": (op8_sharding, None),
    "op9_bit_planes": (op9_bit_planes, None),
    "op10_quality": (op10_quality, None),
    "op11_middle": (op11_middle, OP11),
    "op12_periods": (op12_periods, None),
    "op13_repeats": (op13_repeats, OP13),
}
