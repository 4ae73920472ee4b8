"""The queries of this subpackage's operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, merkle, neardup, ogg, packing, pii, quality, secrets, simhash, spelling, token_files, tokens, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of 2048 ids."""
    packed = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to token files and read back."""
    manifest = token_files.write_token_files(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.personal_data(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.label(F.col("base")), 256).alias("base_sha256"), pii.label(F.col("spans")).alias("spans"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return tokens.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written to archives and read back by the salvaging reader."""
    manifest = warc.write_archives(_read(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, strict=True, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k
"""


def op4_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an Ogg column and read back from it."""
    return ogg.read_media(ogg.add_media(_read(spark, sf_dir, "documents")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, from labels outside the held-out fold."""
    documents = _read(spark, sf_dir, "documents")
    return quality.scored(documents, quality.train(documents, _read(spark, sf_dir, "labels")))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return neardup.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark."""
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), clean=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP9_SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, 10 AS n, list_aggregate(w[i:i + 9], 'string_agg', ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM iw WHERE len(w) >= 10)
  UNION
  SELECT item_id, len(w) AS n, list_aggregate(w, 'string_agg', ' ') AS g FROM iw WHERE len(w) BETWEEN 1 AND 9),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT doc_id, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, occ.n, item_id FROM occ JOIN win ON occ.n = win.n AND occ.g = win.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = secrets.secret_spans(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the Merkle manifest, and whether a fifth of them, tampered with, still verify."""
    changed = [F.translate("text", CAPITALS, SMALL) if c == "text" else F.col(c) for c in MANIFEST_FIELDS]
    tampered = F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, merkle.leaf_digest(changed))
    out = merkle.manifest(_read(spark, sf_dir, "documents"), MANIFEST_FIELDS, "source", "doc_id", tampered, proofs=False)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 (reflected polynomial 0xEDB88320) of a text's bytes in UTF-8: a byte is mixed in, then eight
    single-bit steps follow, marked by -1."""
    digits = f"hex(encode({text}))"
    byte = lambda k: f"strpos('0123456789ABCDEF', substr({digits}, {k}, 1)) - 1"
    steps = f"flatten(list_transform(range(CAST(len({digits}) // 2 AS BIGINT)), lambda i: [CAST(16 * ({byte('CAST(2 * i + 1 AS BIGINT)')}) + {byte('CAST(2 * i + 2 AS BIGINT)')} AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CAST(3988292384 AS BIGINT) * (c & 1)) END), CAST(4294967295 AS BIGINT))"


def _tree_sql(name: str, levels: int) -> str:
    """CTEs of a tree's levels over {name}0 (g, pos, d, n), with each node's siblings at its left and right; levels that a tree hasn't
    pass its top node on."""
    out = []
    for k in range(levels):
        t, up = f"{name}{k}", f"{name}{k + 1}"
        out.append(f"{up} AS (SELECT g, pos // 16 AS pos, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY {t}.pos)) ELSE any_value(d) END AS d, (n + 15) // 16 AS n FROM {t} GROUP BY g, {t}.pos // 16, n)")
        out.append(f"{name}s{k} AS (SELECT a.g, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r FROM {t} a JOIN {t} b ON a.g IS NOT DISTINCT FROM b.g AND a.pos // 16 = b.pos // 16 GROUP BY a.g, a.pos)")
    return ",\n".join(out)


def _fold_sql(name: str, levels: int, start: str) -> tuple[str, str, str]:
    """(joins, the siblings in a row, the folded digest) for rows x with {name}g, {name}pos and {name}n."""
    joins, row, folded = [], [], start
    for k in range(levels):
        s = f"{name}s{k}"
        joins.append(f"LEFT JOIN {s} ON {s}.g IS NOT DISTINCT FROM x.{name}g AND {s}.pos = x.{name}pos // CAST({16**k} AS BIGINT)")
        row.append(f"{s}.l || {s}.r")
        folded = f"(SELECT CASE WHEN x.{name}n > {16**k} THEN sha256({s}.l || f || {s}.r) ELSE f END FROM (SELECT {folded} AS f))"
    return "\n".join(joins), " || ".join(row), folded


def _op11_sql() -> str:
    """Trees of up to 16**5 documents of a source and 16**3 sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)) END"
    leaf = lambda text: "sha256(concat(" + ", ".join(field(text if c == "text" else c) for c in MANIFEST_FIELDS) + "))"
    joins, row, folded = _fold_sql("d", 5, "x.start")
    up_joins, up_row, up_folded = _fold_sql("t", 3, "y.folded")
    return f"""
WITH leaves AS (
  SELECT doc_id, source, {leaf("text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf(f"translate(text, '{CAPITALS}', '{SMALL}')")} END AS changed
  FROM documents),
d AS (SELECT *, source AS dg, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS dpos, count(*) OVER (PARTITION BY source) AS dn FROM leaves),
d0 AS (SELECT dg AS g, dpos AS pos, leaf AS d, dn AS n FROM d),
{_tree_sql("d", 5)},
sub AS (SELECT g AS source, d AS subroot, 0 AS tg, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS tpos, count(*) OVER () AS tn FROM d5),
t0 AS (SELECT tg AS g, tpos AS pos, subroot AS d, tn AS n FROM sub),
{_tree_sql("t", 3)},
x AS (SELECT d.*, sub.subroot, sub.tg, sub.tpos, sub.tn, coalesce(changed, leaf) AS start FROM d JOIN sub ON d.source IS NOT DISTINCT FROM sub.source),
y AS (SELECT x.*, {row} AS siblings, {folded} AS folded FROM x {joins}),
z AS (SELECT y.doc_id, y.leaf, y.subroot, y.siblings || {up_row} AS siblings, {up_folded.replace("x.", "y.")} AS folded_root FROM y {up_joins.replace("x.", "y.")})
SELECT z.doc_id, z.leaf, z.subroot, t3.d AS root, sha256(z.siblings) AS proof_sha256, z.folded_root, z.folded_root = t3.d AS verified
FROM z, t3
"""


#: Runs whose CRC-32 this divides lose a code point.
DAMAGED = 97


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with the form that it is probably a slip of."""
    return spelling.spelling_variants(_read(spark, sf_dir, "documents"), every=DAMAGED)


OP12_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, w, count(*) AS k FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents)
  GROUP BY 1, 2),
hashed AS (SELECT w, k, {_crc32_sql("doc_id || ':' || w")} AS h, CAST(length(w) AS BIGINT) AS size FROM runs),
words AS (
  SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(w, 1, h % size) || substr(w, h % size + 2) ELSE w END AS word, k FROM hashed),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM words WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS part FROM (SELECT word, n, unnest(range(CAST(length(word) AS BIGINT))) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.part = b.part AND a.word <> b.word
  UNION SELECT v.word, l.word, l.n FROM v JOIN less l ON v.word = l.part
  UNION SELECT l.word, v.word, v.n FROM v JOIN less l ON v.word = l.part),
ranked AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM pairs),
f AS (
  SELECT v.word, v.n, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n, coalesce(n_near, 0) AS n_near
  FROM v LEFT JOIN ranked r ON v.word = r.word AND r.r = 1),
walk AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT walk.word, f.form, steps + 1 FROM walk JOIN f ON walk.root = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, steps) AS root FROM walk GROUP BY 1)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN roots USING (word)
"""


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SimHash component of every document."""
    return simhash.simhash_components(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op1_packing": op1_packing, "op2_warc": op2_warc, "op3_token_files": op3_token_files, "op4_ogg": op4_ogg, "op5_pii": op5_pii, "op6_token_counts": op6_token_counts, "op7_quality": op7_quality, "op8_near_duplicates": op8_near_duplicates, "op9_decontamination": op9_decontamination, "op10_secrets": op10_secrets, "op11_merkle_manifest": op11_merkle_manifest, "op12_spelling_variants": op12_spelling_variants, "op13_simhash": op13_simhash}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op9_decontamination": OP9_SQL, "op11_merkle_manifest": _op11_sql(), "op12_spelling_variants": OP12_SQL}
