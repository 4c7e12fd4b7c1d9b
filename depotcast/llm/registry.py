"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotcast.llm import (
    byte_bpe, chat, clustering, decontaminate, embedding_dedup, filter_audit, language_id, license_scan, sharding, simhash,
    substring_dedup, token_counts, token_files,
)
from depotcast.llm.common import forget, scratch_folder, stored, table

#: Appended to every document by ``op1_token_files``.
END_ID = 1


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    folder = scratch_folder(spark, "token-files")
    token_files.write_token_files(
        table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=END_ID
    )
    return token_files.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that any benchmark window covers."""
    found = decontaminate.find_leaks(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    leaks = F.col("leaks")
    return found.select(
        "doc_id",
        leaks["n_words"].alias("n_words"),
        leaks["n_hit"].alias("n_hit"),
        F.size(leaks["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(leaks["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (leaks["n_hit"] > 0).alias("contaminated"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and what they decode to."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode_table(docs, ranks, pattern, decoded="decoded")
    return byte_bpe.digests(coded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


#: Conversation -1 of ``op5_chat_format``: texts made of the template's own marks.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one full of control strings: formatted, written and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast(turns.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    examples = stored(chat.expand(turns.unionByName(control)), "examples")
    replies = F.array_join("replies", "")
    wording = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chat.read_back(examples).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(wording.cast("binary"), 256).alias("turns_sha256"),
        F.length(replies).cast("long").alias("loss_chars"),
        F.sha2(replies.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: Versions that ``op6_token_counts`` counts: kind, file and pattern. ``words-2`` follows ``words-1``.
TOKENIZERS = {
    "byte_bpe_50k": ("ranks", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "words-1": ("words", None, None),
    "words-2": ("pattern", None, r"[\p{L}\p{N}]+"),
}


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents but the toxic ones of low quality, from signed batches.

    All documents are loaded; all counts of the first word tokenizer are revised to its next version;
    toxic documents are deleted; those of them that are of good quality come back; deltas are
    compacted in between, and every batch is sent twice.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    counted = stored(token_counts.count_tokens(docs, TOKENIZERS, keep=["doc_id"]), "counted")
    first, second = (counted.where(F.col("tokenizer") == v) for v in ("words-1", "words-2"))
    present = counted.where(F.col("tokenizer") != "words-1")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    good = labels.where("toxic = 1 and quality = 1").select("doc_id").distinct()
    totals = token_counts.Rollup(spark, scratch_folder(spark, "token-counts"))
    batches = {
        "load": token_counts.inserts(counted.where(F.col("tokenizer") != "words-2")),
        "next-version": token_counts.revisions(first, second),
        "toxic": token_counts.deletes(present.join(toxic, "doc_id", "left_semi")),
        "restored": token_counts.inserts(present.join(good, "doc_id", "left_semi")),
    }
    for k, (name, changes) in enumerate(batches.items()):
        for _ in range(2):  # the second time changes nothing
            totals.commit(name, changes)
        if k == 1:
            totals.compact("1")
    forget(counted)
    return totals.totals()


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps when repeated windows go."""
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.col("repeats")
    return cut.select(
        "doc_id", found["n_words"].alias("n_words"), found["n_removed"].alias("n_removed"),
        F.sha2(found["kept"].cast("binary"), 256).alias("kept_sha256"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a model of the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    language = F.col("language")
    return found.select("doc_id", language_id.held_out().alias("held_out"), language["lang"].alias("lang_pred"), language["score"].alias("score"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and license templates in all documents."""
    found = license_scan.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = F.col("licenses")
    return found.select(
        "doc_id", *[of[n].alias(n) for n in ("n_words", "n_base", "first_word", "last_word")],
        F.array_join(of["base_labels"], ",").alias("base_labels"), F.array_join(of["labels"], ",").alias("labels"), of["score"].alias("score"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters does in every order, by source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Shards of ``op12_sharding``.
SHARDS = 40


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of all documents under the law of nearly equal bytes."""
    dealt = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS, scratch_folder(spark, "slot-map"))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors after five rounds."""
    return clustering.with_inertia(*clustering.cluster(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_decontamination": op2_decontamination,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_simhash": op4_simhash,
    "op5_chat_format": op5_chat_format,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_language_id": op9_language_id,
    "op10_license_scan": op10_license_scan,
    "op11_filter_audit": op11_filter_audit,
    "op12_sharding": op12_sharding,
    "op13_clustering": op13_clustering,
}

#: Words of ``text`` as operators 2 and 10 take them.
_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op2_decontamination": f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS size,
         list_slice(w, i, i + least(10, len(w)) - 1) AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
),
doc AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS.format('text')} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT row, i, size, list_slice(w, i, i + size - 1) AS words
  FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, sizes WHERE len(w) >= size)
),
hits AS (SELECT p.row, p.i, p.size, n.item FROM places p JOIN windows n USING (size, words)),
covered AS (
  SELECT row, count(DISTINCT place) AS n_hit
  FROM (SELECT row, unnest(range(i, i + size)) AS place FROM hits) GROUP BY row
),
named AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
""",
    "op5_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
written AS (
  SELECT *, regexp_replace(text, '(\\*)(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\])', '\\\1\2', 'g') AS inside,
         regexp_replace(role, '(\\*)(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\])', '\\\1\2', 'g') AS role_inside
  FROM turns
),
sized AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(length(inside) + CASE role WHEN 'system' THEN length('<<SYS>>  <</SYS>>') WHEN 'user' THEN length('<s>[INST]  [/INST]')
             WHEN 'assistant' THEN length('  </s>') ELSE length('[ROLE]  [/ROLE]  </s>') + length(role_inside) END) OVER w AS up_to
  FROM written WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(up_to) FILTER (role = 'assistant' OR place = n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""",
    "op7_substring_dedup": r"""
WITH doc AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
places AS (
  SELECT row, doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS words
  FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc WHERE len(w) >= 13)
),
judged AS (SELECT row, i, doc_id > min(doc_id) OVER (PARTITION BY words) AS again FROM places),
gone AS (SELECT DISTINCT row, unnest(range(i, i + 13)) AS place FROM judged WHERE again),
word AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM doc),
kept AS (
  SELECT row, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS words FROM word ANTI JOIN gone USING (row, place) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(words, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (row)
""",
    "op8_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND list_sum([CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END FOR x IN embedding]) = 0
    AND list_sum([abs(x) FOR x IN embedding]) > 0
),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c.component_id, c.component_id = e.vec_id AS kept
FROM embeddings e JOIN component c ON c.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
""",
    "op11_filter_audit": r"""
WITH doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
least AS (SELECT t, min(doc_id) AS least FROM doc GROUP BY t),
good AS (SELECT DISTINCT doc_id, 1 AS good FROM labels WHERE quality = 1),
toxic AS (SELECT DISTINCT doc_id, 1 AS toxic FROM labels WHERE toxic = 1),
cell AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
           || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
           || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
           || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
    FROM doc JOIN least USING (t) LEFT JOIN good USING (doc_id) LEFT JOIN toxic USING (doc_id)
  ) GROUP BY part, fails
),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
),
met AS (
  SELECT part, filter_order, fails, n, good, toxic,
         least(CASE WHEN contains(fails, filter_order[1]) THEN 1 ELSE 6 END, CASE WHEN contains(fails, filter_order[2]) THEN 2 ELSE 6 END,
               CASE WHEN contains(fails, filter_order[3]) THEN 3 ELSE 6 END, CASE WHEN contains(fails, filter_order[4]) THEN 4 ELSE 6 END,
               CASE WHEN contains(fails, filter_order[5]) THEN 5 ELSE 6 END) AS goes
  FROM cell, orders
),
step AS (
  SELECT part, filter_order, s AS step, filter_order[s] AS f,
         coalesce(sum(n) FILTER (goes > s), 0) AS kept, coalesce(sum(n) FILTER (goes = s), 0) AS removed,
         coalesce(sum(n) FILTER (goes < s AND contains(fails, filter_order[s])), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = filter_order[s]), 0) AS unique_fails,
         coalesce(sum(good) FILTER (goes = s), 0) AS good_lost, coalesce(sum(toxic) FILTER (goes = s), 0) AS toxic_lost
  FROM met, range(1, 6) AS r(s) GROUP BY part, filter_order, s
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM step
""",
    "op13_clustering": "WITH v AS MATERIALIZED ("
    "SELECT row_number() OVER () AS row, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x "
    "FROM embeddings WHERE len(embedding) = 64 "
    "AND list_sum([CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END FOR x IN embedding]) = 0),\n"
    "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x "
    "FROM v WHERE vec_id IS NOT NULL QUALIFY c < 40),\n"
    + ",\n".join(
        f"""a{r} AS MATERIALIZED (
  SELECT row, c, d FROM (
    SELECT v.row, c.c, list_sum([(v.x[i] - c.x[i]) * (v.x[i] - c.x[i]) FOR i IN range(1, 65)]) AS d FROM v, c{r} c
  ) QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1
),
c{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x
    FROM (SELECT a.c, i, CAST(sum(v.x[i]) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN v USING (row), range(1, 65) AS t(i) GROUP BY a.c, i)
    GROUP BY c
  ) m ON m.c = c.c
)"""
        for r in range(6)
    )
    + """
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c5.x, ',')) AS centroid_sha256
FROM a5 a JOIN v USING (row) JOIN c5 ON c5.c = a.c
""",
}
