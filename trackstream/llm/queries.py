"""Registered training-data queries and, where SQL can express them, the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackstream.llm import bpe, decontam, fingerprints, katz, licenses, merkle, pii, rollups, simhash, toxicity, urls, vectorcodes, wordbpe
from trackstream.llm.common import discard, fold, join_values, materialize, new_path, table


# The host-and-path rules that the URL query is defined with.
URL_RULES = [
    urls.Rule("org", "/", "allow"),
    urls.Rule("example.org", "/es/", "block"),
    urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"),
    urls.Rule("com", "/de/", "block"),
]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    mined = urls.mine(pages, "page_id", "url", labels.select("doc_id", bad.cast("int").alias("block")))
    judged = urls.judge(pages.select("page_id", "url"), "url", URL_RULES, mined)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_confidence")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"), "doc_id", "text")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, "text", pii.fit(docs, "text"))
    base = F.filter("pii", lambda s: s["base"])
    counts = [F.expr(f"cast(size(filter(pii, s -> s.base and s.kind = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.as_text(base), 256).alias("base_sha256"), pii.as_text(F.col("pii")).alias("spans"))


def _word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def _letter_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"))


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: all documents come; exact copies but the first go; documents with an ``@`` are recounted without
    their address-like words. The second batch is committed twice, as after a lost driver. Documents without an id cannot
    be told apart later: they come and stay as they are. Documents are told by id and text, so a repeated id is no harm."""
    docs = table(spark, sf_dir, "documents")
    folder = new_path(spark, "rollup")
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(text, 256)
    versions = {"words_v1": _word_count(text), "pieces_v1": _letter_count(text)}
    ledger = materialize(rollups.counted(docs, "doc_id", versions, {"digest": digest}), "ledger")
    rollups.commit(rollups.inserts(ledger), folder, "b1")
    digests = ledger.where("tokenizer = 'words_v1'").select("doc_id", "digest")
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = materialize(join_values(digests, firsts, "digest", "n").where("doc_id > first").select("doc_id", "digest").distinct(), "copies")
    gone = ledger.join(copies, ["doc_id", "digest"], "left_semi")
    rollups.commit(rollups.deletes(gone), folder, "b2")
    rollups.commit(rollups.deletes(gone), folder, "b2")
    changed = docs.where(F.col("doc_id").isNotNull() & F.contains(text, F.lit("@"))).withColumn("digest", digest)
    changed = changed.join(copies, ["doc_id", "digest"], "left_anti").withColumn("text", F.regexp_replace("text", r"[^\x20\x09-\x0D]*@[^\x20\x09-\x0D]*", ""))
    after = materialize(rollups.counted(changed, "doc_id", versions, {"digest": F.col("digest")}), "recounted")
    before = ledger.join(after.select("doc_id", "digest").distinct(), ["doc_id", "digest"], "left_semi")
    rollups.commit(rollups.revisions(before, after), folder, "b3")
    discard(ledger, copies, after)
    return rollups.totals(spark, folder)


OP5_SQL = r"""
WITH copies AS (SELECT *, doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS copy FROM documents),
left_over AS (SELECT source, lang, CASE WHEN contains(coalesce(text, ''), '@')
    THEN regexp_replace(text, '[^\x20\x09-\x0D]*@[^\x20\x09-\x0D]*', '', 'g') ELSE coalesce(text, '') END AS text
    FROM copies WHERE NOT copy),
counts AS (
    SELECT source, lang, 'words_v1' AS tokenizer, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM left_over
    UNION ALL
    SELECT source, lang, 'pieces_v1', len(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]')) FROM left_over)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM counts GROUP BY ALL
"""


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs, "text")
    n = F.col("licenses")
    spans = F.array_join(F.transform(n, lambda x: F.concat_ws(":", x["license"], x["start"], x["end"], F.size(x["missing"]), F.size(x["added"]))), ",")
    return found.select("doc_id", F.size(n).cast("long").alias("n_notices"), licenses.names(n).alias("licenses"), spans.alias("notices"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", max_bits=2, size=3)
    return found.withColumn("fingerprint", simhash.as_hex(F.col("fingerprint")))


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order two: three orders need more disk than there is (README). A row without an id is scored, but is neither held
    out nor learned from."""
    scored = katz.score(table(spark, sf_dir, "documents"), "doc_id", "text", fold(F.col("doc_id"), 7) != 2, order=2)
    return scored.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id is judged, but is neither held out nor learned from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, toxicity.in_training())
    judged = toxicity.judge(docs.select("doc_id", "text"), model, "text")
    score = F.col("toxicity.score")
    return judged.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        F.size("toxicity.segments").alias("n_segments"),
    )


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    judged = decontam.scan(docs.select("doc_id", "text"), benchmark, "text", "item_id", "text", size=13)
    found = F.col("contamination")
    return judged.select(
        "doc_id",
        found["n_words"].alias("n_words"),
        found["n_hit"].alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ","), 256).alias("items_sha256"),
        decontam.contaminated(found).alias("contaminated"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def _op11_sql(rounds: int = 6) -> str:
    """Plain k-means by all distances, one pair of steps a round."""
    near = """a{k} AS MATERIALIZED (
    SELECT rid, part, min(d) AS d, arg_min(entry, d * 16 + entry) AS entry FROM (
        SELECT rid, p.part, entry, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d
        FROM parts p JOIN c{k} ON c{k}.part = p.part) GROUP BY rid, part)"""
    moved = """c{n} AS MATERIALIZED (
    SELECT part, entry, coalesce(new, c) AS c FROM c{k} LEFT JOIN (
        SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS new FROM (
            SELECT a.part, entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{k} a JOIN parts p ON a.rid = p.rid AND a.part = p.part, range(1, len(x) + 1) t(i)
            GROUP BY a.part, entry, i) GROUP BY part, entry) USING (part, entry))"""
    steps = [near.format(k=0)]
    for k in range(rounds):
        steps += [moved.format(k=k, n=k + 1), near.format(k=k + 1)]
    return """
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rid, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS x FROM kept, range(8) t(part)),
c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x AS c FROM parts WHERE rid <= 16),
STEPS,
coded AS (SELECT rid, string_agg(format('{:02x}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM aLAST GROUP BY rid),
rows AS (SELECT vec_id, label, code, error FROM coded JOIN kept USING (rid)),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM cLAST)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM rows CROSS JOIN books
""".replace("STEPS", ",\n".join(steps)).replace("LAST", str(rounds))


MERKLE_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id is a leaf as any other and is never tampered with."""
    docs = table(spark, sf_dir, "documents").select(*MERKLE_FIELDS)
    stripped = F.when(fold(F.col("doc_id"), 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    tampered = merkle.leaf(*map(F.col, MERKLE_FIELDS[:-1]), stripped)
    found = merkle.manifest(docs, "doc_id", "source", MERKLE_FIELDS, {"tampered": tampered})
    folded = merkle.fold(F.col("row.tampered"), F.col("witness"))
    out = found.select(F.col("row.id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof(F.col("witness")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
    SELECT doc_id, xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || list_transform(range(1, length(d) + 1), lambda i: ascii(substr(d, i))::UBIGINT),
        lambda c, b: list_reduce([xor(c, b)] || list_transform(range(8), lambda k: k::UBIGINT), lambda x, k: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))) AS crc
    FROM (SELECT DISTINCT doc_id, doc_id::VARCHAR AS d FROM documents)),
told AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce('1' || source, '0') AS grp, text,
        concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
            coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
        CASE WHEN crc.crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut
    FROM documents LEFT JOIN crc USING (doc_id)),
digests AS (
    SELECT rid, doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS tampered FROM told),
leaves AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM digests),
nodes AS (
    SELECT 0 AS level, grp, pos, leaf AS digest, count(*) OVER (PARTITION BY grp) AS n FROM leaves
    UNION ALL
    SELECT level + 1, grp, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY level, grp, pos // 3),
subroots AS MATERIALIZED (
    SELECT grp, digest AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos FROM nodes WHERE n = 1),
tops AS (
    SELECT 0 AS level, pos, subroot AS digest, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, pos // 3),
runs AS MATERIALIZED (SELECT level, grp, pos // 3 AS up, list(digest ORDER BY pos) AS run FROM nodes WHERE n > 1 GROUP BY ALL),
top_runs AS MATERIALIZED (SELECT level, pos // 3 AS up, list(digest ORDER BY pos) AS run FROM tops WHERE n > 1 GROUP BY ALL),
walk AS (
    SELECT rid, grp, 0 AS level, pos, tampered AS node, '' AS proof FROM leaves
    UNION ALL
    SELECT rid, w.grp, w.level + 1, w.pos // 3,
        sha256(array_to_string(run[:w.pos % 3], '') || node || array_to_string(run[w.pos % 3 + 2:], '')),
        proof || array_to_string(run[:w.pos % 3], '') || array_to_string(run[w.pos % 3 + 2:], '')
    FROM walk w JOIN runs r ON r.level = w.level AND r.grp = w.grp AND r.up = w.pos // 3),
at_subroot AS MATERIALIZED (
    SELECT rid, grp, arg_max(node, level) AS node, arg_max(proof, level) AS proof FROM walk GROUP BY rid, grp),
climb AS (
    SELECT rid, 0 AS level, s.pos, node, proof FROM at_subroot JOIN subroots s USING (grp)
    UNION ALL
    SELECT rid, c.level + 1, c.pos // 3,
        sha256(array_to_string(run[:c.pos % 3], '') || node || array_to_string(run[c.pos % 3 + 2:], '')),
        proof || array_to_string(run[:c.pos % 3], '') || array_to_string(run[c.pos % 3 + 2:], '')
    FROM climb c JOIN top_runs r ON r.level = c.level AND r.up = c.pos // 3),
ends AS (SELECT rid, arg_max(node, level) AS folded_root, arg_max(proof, level) AS proof FROM climb GROUP BY rid),
whole AS (SELECT digest AS root FROM tops WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN ends USING (rid) JOIN subroots USING (grp) CROSS JOIN whole
"""


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.digests(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_urls": op2_urls, "op3_fingerprints": op3_fingerprints, "op4_pii": op4_pii, "op5_token_rollup": op5_token_rollup, "op7_licenses": op7_licenses, "op6_simhash": op6_simhash, "op8_katz": op8_katz, "op9_toxicity": op9_toxicity, "op10_decontam": op10_decontam, "op11_vector_codes": op11_vector_codes, "op12_merkle": op12_merkle, "op13_word_bpe": op13_word_bpe}


def oracle_sql() -> dict[str, str]:
    return {"op5_token_rollup": OP5_SQL, "op11_vector_codes": _op11_sql(), "op12_merkle": OP12_SQL}
