"""One query for each operator of the subpackage over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.llm import bpe, chat, equal_average, ns_clustering, quality, store, token_files, toxicity, warc
from meshframe.llm.ann import nearest
from meshframe.llm.decontaminate import find_leaks
from meshframe.llm.html import extract
from meshframe.llm.jaccard import similar_components
from meshframe.llm.sampling import remainder
from meshframe.llm.substrings import remove_repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept").withColumnRenamed("kept", "kept_sha256")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (remainder("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "offending")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    names = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 for poor quality, 1 for good quality that is toxic, 2 for good quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grades = table(spark, sf_dir, "labels").selectExpr("doc_id", "case when quality = 0 then 0 when quality = 1 then if(toxic = 1, 1, 2) end grade")
    scored = quality.score(docs, grades)
    tail = F.col("tails")[0]
    return scored.select("doc_id", (remainder("doc_id") == 2).alias("held_out"), "expected_grade", tail.alias("score"), (tail >= quality.THRESHOLD).cast("int").alias("predicted"), F.col("tails")[1].alias("top_probability"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path(vocabulary), public_tokenizers.PATTERN).drop("text")


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).drop("record_id", "target_uri")


def op7_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.preference_pairs(chat.stale_answers(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ",")
    return found.select("conv_id", "prompt_turns", "prompt", "chosen", "rejected", spans("chosen_spans").alias("chosen_spans"), spans("rejected_spans").alias("rejected_spans"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_balanced_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter("vec_id % 20 = 0"))


def op11_equal_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = equal_average.train(rows)
    coded = equal_average.summed(equal_average.encode(rows, books).drop("embedding"), "label")
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(equal_average.digest(books)).alias("codebooks_sha256"))


def op12_ns_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = ns_clustering.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    found = store.stored(found.drop("embedding"), "clustered")
    sums = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}
    inertia = [sums.get(j, 0) for j in range(len(centroids))]
    return found.select("vec_id", "cluster", "distance", ns_clustering.picked(inertia, "cluster").cast("long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), ns_clustering.picked(ns_clustering.digests(centroids), "cluster").cast("string").alias("centroid_sha256"))


def op13_token_files(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    path = store.place(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(vocabulary), path, end=2)
    return token_files.read(spark, path, raw=True).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_ordinal_quality": op4_ordinal_quality,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_arc_to_warc": op6_arc_to_warc,
    "op7_preference_pairs": op7_preference_pairs,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_html_text": op9_html_text,
    "op10_balanced_lists": op10_balanced_lists,
    "op11_equal_average": op11_equal_average,
    "op12_ns_clustering": op12_ns_clustering,
    "op13_token_files": op13_token_files,
}

#: Words of a text with A-Z lower-cased, in SQL.
_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op2_decontaminate": rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w FROM benchmark),
k AS (SELECT DISTINCT item_id, least(len(w), 10) n, array_to_string(w[i:i + 9], ' ') s
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM k),
p AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') s
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT p.doc_id, p.i, p.n, k.item_id FROM p JOIN k ON p.n = k.n AND p.s = k.s),
hits AS (SELECT doc_id, count(DISTINCT j) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) j FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) n_items, string_agg(x, ',' ORDER BY x) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) x FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op3_ngram_jaccard": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_ASCII_LOWER}, '[^\x20\x09-\x0D]+'), []) w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.s = b.s AND a.doc_id != b.doc_id GROUP BY x, y),
e AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id x, doc_id y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT doc_id, coalesce(any_value(n.n), 0) n_shingles, min(r.y) component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON d.doc_id = r.x GROUP BY doc_id""",
    "op6_arc_to_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) n, sha256(coalesce(html, '')) d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) f FROM p)
SELECT page_id, n payload_bytes, d payload_digest, CASE WHEN n >= 100 AND page_id != f THEN 'revisit' ELSE 'response' END record_type,
       CASE WHEN n >= 100 AND page_id != f THEN f END refers_to FROM f""",
    "op7_preference_pairs": """
WITH t AS (SELECT conv_id, role, text, CASE WHEN role = 'assistant' AND lead_in > 1 THEN before ELSE text END stale,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) i
           FROM (SELECT *, lag(text) OVER w before, row_number() OVER w lead_in FROM conversations
                 WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn NULLS FIRST, text NULLS FIRST))),
m AS (SELECT conv_id, coalesce(min(i) FILTER (text IS DISTINCT FROM stale), max(i) + 1) m FROM t GROUP BY conv_id),
s AS (SELECT t.*, m, 5 + length(coalesce(role, 'unknown')) h, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) head, coalesce(text, '') || '<|end|>' || chr(10) a, coalesce(stale, '') || '<|end|>' || chr(10) b FROM t JOIN m USING (conv_id)),
p AS (SELECT *, sum(h + length(a)) FILTER (i >= m) OVER (PARTITION BY conv_id ORDER BY i) za, sum(h + length(b)) FILTER (i >= m) OVER (PARTITION BY conv_id ORDER BY i) zb FROM s)
SELECT conv_id, CAST(any_value(m) - 1 AS INTEGER) prompt_turns, coalesce(string_agg(head || a, '' ORDER BY i) FILTER (i < m), '') prompt,
  coalesce(string_agg(head || a, '' ORDER BY i) FILTER (i >= m), '') chosen, coalesce(string_agg(head || b, '' ORDER BY i) FILTER (i >= m), '') rejected,
  coalesce(string_agg((za - length(a)) || '-' || za, ',' ORDER BY i) FILTER (i >= m AND role = 'assistant'), '') chosen_spans,
  coalesce(string_agg((zb - length(b)) || '-' || zb, ',' ORDER BY i) FILTER (i >= m AND role = 'assistant'), '') rejected_spans
FROM p GROUP BY conv_id""",
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM p WHERE s IN (SELECT s FROM p GROUP BY s HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) j FROM r),
x AS (SELECT doc_id, list(j) js, count(*) n FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n, 0) n_removed,
       sha256(coalesce(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
              ELSE (SELECT string_agg(w[j], ' ' ORDER BY j) FROM (SELECT unnest(range(1, len(w) + 1)) j) WHERE NOT list_contains(js, j)) END, '')) kept_sha256
FROM d LEFT JOIN x ON d.doc_id = x.doc_id""",
}

#: Usable vectors as doubles that hold integers; their products are exact.
_FIXED = "[floor(1024 * CAST(x AS DOUBLE)) for x in embedding]"
_FINITE = "embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"


def _mean(rows: str, by: str, length: str) -> str:
    """The floor of the mean of each component of e in rows, by `by`."""
    return f"""(SELECT {by}, list((s - ((s % c) + c) % c) // c ORDER BY i) m FROM (SELECT {by}, i, sum(CAST(e[i] AS BIGINT)) s, count(*) c
  FROM (SELECT {by}, e, unnest(range(1, {length} + 1)) i FROM {rows}) GROUP BY {by}, i) GROUP BY {by})"""


_SQUARED = "CAST(list_inner_product(a.e, a.e) - 2 * list_inner_product(a.e, b.e) + list_inner_product(b.e, b.e) AS BIGINT)"


def _codebook_rounds(rounds: int) -> str:
    out = []
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (SELECT r, a.part, any_value(a.e) e, min({_SQUARED} * 256 + k) m FROM p a JOIN b{i} b ON a.part = b.part GROUP BY r, a.part)""")
        if i < rounds:
            out.append(f"""b{i + 1} AS MATERIALIZED (SELECT b.part, b.k, CASE WHEN m IS NULL THEN e ELSE [CAST(x AS DOUBLE) for x in m] END e
  FROM b{i} b LEFT JOIN {_mean(f"(SELECT part, m % 256 k, e FROM a{i})", "part, k", "len(e)")} n ON b.part = n.part AND b.k = n.k)""")
    return ",\n".join(out)


def _centroid_rounds(rounds: int) -> str:
    out = []
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (SELECT r, any_value(a.e) e, min({_SQUARED} * 8 + k) m FROM v a, b{i} b GROUP BY r)""")
        if i < rounds:
            out.append(f"""b{i + 1} AS MATERIALIZED (SELECT b.k, CASE WHEN m IS NULL THEN e ELSE [CAST(x AS DOUBLE) for x in m] END e
  FROM b{i} b LEFT JOIN {_mean(f"(SELECT m % 8 k, e FROM a{i})", "k", "len(e)")} n ON b.k = n.k)""")
    return ",\n".join(out)


_DECIMAL = "array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) for x in e], ',')"

ORACLE["op11_equal_average"] = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 r, vec_id, label, {_FIXED} e FROM embeddings WHERE {_FINITE}),
p AS MATERIALIZED (SELECT r, part, e[part * (len(e) // 4) + 1 : (part + 1) * (len(e) // 4)] e FROM (SELECT r, e, unnest(range(4)) part FROM v)),
b0 AS MATERIALIZED (SELECT part, r k, e FROM p WHERE r < 256),
{_codebook_rounds(4)},
c AS (SELECT r, string_agg(format('{{:02x}}', m % 256), '' ORDER BY part) code, CAST(sum(m // 256) AS BIGINT) error FROM a4 GROUP BY r),
s AS (SELECT sha256(string_agg({_DECIMAL}, ',' ORDER BY part, k)) s FROM b4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) label_error, s codebooks_sha256 FROM v JOIN c USING (r), s"""

ORACLE["op12_ns_clustering"] = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 r, vec_id, {_FIXED} e FROM embeddings WHERE {_FINITE} AND len(embedding) = 64),
b0 AS MATERIALIZED (SELECT r k, e FROM v WHERE r < 8),
{_centroid_rounds(10)},
f AS (SELECT r, CAST(m % 8 AS INTEGER) cluster, m // 8 distance FROM a10)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) inertia,
       sha256({_DECIMAL.replace(" in e]", " in b10.e]")}) centroid_sha256
FROM v JOIN f USING (r) JOIN b10 ON b10.k = cluster"""
