"""The queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.chat_format import chat_format, loss_text
from quarry.llm.common import read, shared_dir
from quarry.llm.fill_middle import fill_in_middle, restored
from quarry.llm.license_scan import license_scan
from quarry.llm.merkle import FIELDS, fold, leaf_digest, manifest, proof_digest
from quarry.llm.mixing import cube_mix, taken_rows
from quarry.llm.packing import pack
from quarry.llm.quality_rules import quality_rules
from quarry.llm.secret_scan import secret_scan
from quarry.llm.sentencepiece_codec import sentencepiece_encode
from quarry.llm.sharding import reshard, rewrite
from quarry.llm.simhash import simhash_components
from quarry.llm.token_counts import length_histogram, token_lengths
from quarry.llm.topk_search import topk_search

#: Old shards of the resharding query: a layout by source, as uneven as the sources are.
OLD_SHARDS = 12


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_encode(read(spark, sf_dir, "documents"), with_ids=False)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op4_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_rows(cube_mix(read(spark, sf_dir, "documents")))


def op5_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = reshard(docs, old_shard=F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS)))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def reshard_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a resharding: documents stored by old shard, the affected shards written anew, and all shards read back."""
    old, new = (f"{shared_dir(spark)}/quarry-shards-{uuid.uuid4().hex}" for _ in range(2))
    docs = read(spark, sf_dir, "documents").withColumn("shard", F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS)).cast("int"))
    docs.write.partitionBy("shard").parquet(old)
    files = spark.read.schema(docs.schema)
    stored = files.parquet(old)
    touched = rewrite(spark, old, new, reshard(stored, old_shard=F.col("shard")), schema=docs.schema)
    kept = stored.where(~F.col("shard").isin(touched)).select("doc_id", "text", "shard")
    both = files.parquet(new).select("doc_id", "text", "shard").unionByName(kept)
    return both.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.col("shard").cast("int").alias("shard"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(read(spark, sf_dir, "documents"), keep=()))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = chat_format(rows.unionByName(own))
    loss = loss_text(F.col("turns"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
c AS (
  SELECT *, (contains(role || chr(10) || text, '### ') OR contains(role || chr(10) || text, '###e ') OR contains(role || chr(10) || text, '</turn>') OR contains(role, ':') OR contains(role, chr(10))) AS clash,
    length(role || text) AS n,
    length(role || text) - length(replace(replace(replace(replace(role || text, '\', ''), '<', ''), '#', ''), ':', '')) AS esc
  FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(n + CASE WHEN clash THEN 15 + esc ELSE 14 END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search(read(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 50 == 0)


#: The scores are integers, so the brute force is exact in SQL too.
OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read(spark, sf_dir, "documents"))


def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(docs, more={"now": leaf_digest(text if f == "text" else F.col(f) for f in FIELDS)})
    found = found.withColumn("folded_root", fold(F.col("now"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_value(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x} END"


def _sql_leaf(text: str) -> str:
    return f"sha256({' || '.join(_sql_value(text if f == 'text' else f) for f in FIELDS)})"


#: crc32 bit by bit: every eighth step takes a byte in. Its lowest bit is inverted at the end, so an even crc32 is an odd register.
_SQL_CRC = """list_reduce(flatten([[ascii(c), 0, 0, 0, 0, 0, 0, 0] for c in string_split(id, '')]),
  lambda r, x: xor(xor(r, x) >> 1, 3988292384 * (xor(r, x) & 1)), 4294967295::BIGINT)"""


def _sql_tree(name: str, leaves: str) -> str:
    """All nodes (k, lvl, i, d, n) above leaves (k, i, d, n), their families, and each leaf's way up."""
    return f"""{name} AS (SELECT k, 0 AS lvl, i, d, n FROM {leaves} UNION ALL
  SELECT k, lvl + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY k, lvl, i // 3),
{name}_f AS (SELECT k, lvl, i // 3 AS p, any_value(d) FILTER (i % 3 = 0) AS d0, coalesce(any_value(d) FILTER (i % 3 = 1), '') AS d1, coalesce(any_value(d) FILTER (i % 3 = 2), '') AS d2 FROM {name} WHERE n > 1 GROUP BY k, lvl, i // 3)"""


def _sql_way(name: str, tree: str, start: str) -> str:
    return f"""{name} AS (SELECT rid, k, 0 AS lvl, i, now, proof FROM {start} UNION ALL
  SELECT rid, k, lvl + 1, i // 3, sha256(CASE WHEN i % 3 = 0 THEN now ELSE d0 END || CASE WHEN i % 3 = 1 THEN now ELSE d1 END || CASE WHEN i % 3 = 2 THEN now ELSE d2 END),
    proof || CASE WHEN i % 3 = 0 THEN '' ELSE d0 END || CASE WHEN i % 3 = 1 THEN '' ELSE d1 END || CASE WHEN i % 3 = 2 THEN '' ELSE d2 END
  FROM {name} w JOIN {tree}_f f USING (k, lvl) WHERE w.i // 3 = f.p)"""


OP12_SQL = f"""
WITH RECURSIVE c AS (SELECT *, coalesce(doc_id::VARCHAR, '') AS id, row_number() OVER () AS rid, coalesce('=' || source, '-') AS k FROM documents),
c1 AS (SELECT *, CASE WHEN id = '' OR {_SQL_CRC} & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS text_now FROM c),
l AS (SELECT rid, k, doc_id, {_sql_leaf('text')} AS leaf, {_sql_leaf('text_now')} AS now FROM c1),
leaves AS (SELECT *, leaf AS d, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n, '' AS proof FROM l),
{_sql_tree('t', 'leaves')}, {_sql_way('w', 't', 'leaves')},
subs AS (SELECT k AS source_key, 0 AS k, d, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
{_sql_tree('s', 'subs')},
half AS (SELECT w.rid, 0 AS k, subs.i, w.now, w.proof, subs.d AS subroot FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY rid ORDER BY lvl DESC) = 1) w JOIN subs ON w.k = subs.source_key),
{_sql_way('x', 's', 'half')},
folded AS (SELECT rid, now, proof FROM x QUALIFY row_number() OVER (PARTITION BY rid ORDER BY lvl DESC) = 1)
SELECT doc_id, leaf, half.subroot, root.d AS root, sha256(folded.proof) AS proof_sha256, folded.now AS folded_root, folded.now = root.d AS verified
FROM l JOIN half USING (rid) JOIN folded USING (rid), (SELECT d FROM s WHERE n = 1) root
"""


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read(spark, sf_dir, "documents"))
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    return out.select("doc_id", "n", "form", chars("prefix"), chars("middle"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_SQL_H = lambda i: f"('0x' || h[{8 * i - 7}:{8 * i}])::BIGINT"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, len(u)::BIGINT AS n, least({_SQL_H(1)} % (len(u) + 1), {_SQL_H(2)} % (len(u) + 1)) AS a, greatest({_SQL_H(1)} % (len(u) + 1), {_SQL_H(2)} % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_SQL_H(3)} % 100 >= 90 THEN 'plain' WHEN {_SQL_H(4)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, CASE WHEN form <> 'plain' THEN array_to_string(u[:a], '') END AS prefix, CASE WHEN form <> 'plain' THEN array_to_string(u[a + 1:b], '') END AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_license_scan": op2_license_scan,
        "op3_quality_rules": op3_quality_rules,
        "op4_cube_mix": op4_cube_mix,
        "op5_reshard": op5_reshard,
        "reshard_rewrite": reshard_rewrite,
        "op6_token_counts": op6_token_counts,
        "op7_chat_format": op7_chat_format,
        "op8_simhash": op8_simhash,
        "op9_topk_search": op9_topk_search,
        "op10_secret_scan": op10_secret_scan,
        "op11_pack": op11_pack,
        "op12_merkle": op12_merkle,
        "op13_fill_middle": op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_format": OP7_SQL, "op9_topk_search": OP9_SQL, "op12_merkle": OP12_SQL, "op13_fill_middle": OP13_SQL}
