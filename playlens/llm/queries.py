"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.llm import (
    decontamination,
    exact_dedup,
    language_id,
    line_dedup,
    merkle_manifest,
    mixing,
    prefix_trie,
    quality_rules,
    secrets,
    simhash_dedup,
    substring_dedup,
    token_files,
    url_filter,
)
from playlens.llm.common import LOWER, UPPER, read_table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read_table(spark, sf_dir, "documents"))[1].drop("indexed")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup(read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", "keep_runs", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(read_table(spark, sf_dir, "documents")).drop("text")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    return index.add(read_table(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.plan(read_table(spark, sf_dir, "documents")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(read_table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.tampered(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_files": op2_token_files,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_secrets": op5_secrets,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
    "op11_quality_rules": op11_quality_rules,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: Whitespace of the contracts as a DuckDB character class and as a string.
_CLASS = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"


def _crc(column: str) -> str:
    """The unsigned CRC-32 of the decimal digits of an integer in DuckDB: the eight bits of one digit after the other."""
    bits = "list_reduce([xor(crc, c)] || range(8), lambda r, bit: xor(r >> 1, (r & 1) * 3988292384))"
    digits = f"list_transform(string_split({column}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {digits}, lambda crc, c: {bits}), 4294967295::BIGINT)"


def _field(value: str) -> str:
    """A field of a leaf: its bytes, a colon and the value."""
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _step(run: str) -> str:
    """A node's siblings to the left and to the right."""
    ordered = f"string_agg(h, '') OVER (PARTITION BY {run} ORDER BY pos ROWS BETWEEN "
    return f"coalesce({ordered}UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' || coalesce({ordered}1 FOLLOWING AND UNBOUNDED FOLLOWING), '')"


ORACLES: dict[str, str] = {
    "op1_decontamination": r"""
        WITH it AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark),
             ibag AS (SELECT item_id, len(w) AS size, array_to_string(w[i:i + 4], ' ') AS shingle, count(*) AS m
                      FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM it WHERE len(w) >= 5) AS x GROUP BY ALL),
             iw AS (SELECT item_id, sum(m * length(shingle)) AS weight FROM ibag GROUP BY item_id),
             d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS w FROM documents),
             sh AS (SELECT doc_id, i, len(w) AS n, array_to_string(w[i:i + 4], ' ') AS shingle
                    FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5) AS x),
             win AS (SELECT DISTINCT doc_id, item_id, size, unnest(range(greatest(1, i - size + 5), least(i, n - size + 1) + 1)) AS s
                     FROM sh JOIN ibag USING (shingle) WHERE n >= size),
             bag AS (SELECT doc_id, item_id, s, shingle, count(*) AS c FROM win JOIN sh USING (doc_id)
                     WHERE i BETWEEN s AND s + size - 5 GROUP BY ALL),
             sim AS (SELECT doc_id, item_id, s, sum(c * length(shingle)) AS mine,
                            sum(CASE WHEN m IS NULL THEN 0 ELSE least(c, m) END * length(shingle)) AS common
                     FROM bag LEFT JOIN ibag USING (item_id, shingle) GROUP BY ALL),
             ok AS (SELECT doc_id, item_id, s, common::BIGINT AS common, (mine + weight - common)::BIGINT AS total
                    FROM sim JOIN iw USING (item_id) WHERE common >= 0.8::DOUBLE * (mine + weight - common)::DOUBLE)
        SELECT doc_id, item_id, (s - 1)::BIGINT AS start, common, total, common / total AS similarity
        FROM ok QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common / total DESC, s) = 1""",
    "op3_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line
                   FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
             k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
             shared AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
                        GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
             f AS (SELECT k.*, coalesce(doc_id < last, false) AS gone FROM k LEFT JOIN shared USING (key)),
             r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, gone ORDER BY pos) AS run FROM f),
             runs AS (SELECT doc_id, gone, min(pos) AS start, count(*) AS size FROM r GROUP BY doc_id, gone, run),
             texts AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                              sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
                       FROM f GROUP BY doc_id),
             maps AS (SELECT doc_id, CASE WHEN arg_min(gone, start) THEN '0,' ELSE '' END
                                     || string_agg(size::VARCHAR, ',' ORDER BY start) AS keep_runs FROM runs GROUP BY doc_id)
        SELECT doc_id, n_lines, n_dropped, keep_runs, kept_sha256 FROM texts JOIN maps USING (doc_id)""",
    "op4_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
             o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM s),
             gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM o WHERE n > 1),
             left_over AS (SELECT doc_id, list(word ORDER BY pos) AS kept
                           FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d) AS each_word
                           ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(len(kept), 0) AS n_removed,
               sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
        FROM d LEFT JOIN left_over USING (doc_id)""",
    "op6_exact_dedup": rf"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                          sha256(regexp_replace(coalesce(text, ''), '{_CLASS}', '', 'g')) AS text_sha256
                   FROM documents),
             g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
                          count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op11_quality_rules": rf"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
             l AS (SELECT doc_id, source, md5(text) AS digest, unnest(string_split(text, chr(10))) AS line FROM d),
             k AS (SELECT *, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789',
                                                          'abcdefghijklmnopqrstuvwxyz000000000'), '{_WORD}') AS lw FROM l),
             b AS (SELECT *, array_to_string(lw, ' ') AS key FROM k WHERE len(lw) > 0),
             shared AS (SELECT source, key FROM b GROUP BY ALL HAVING count(DISTINCT digest) > 10),
             lost AS (SELECT doc_id, count(DISTINCT b.key) AS n_lines, sum(len(lw)) AS n_gone
                      FROM b JOIN shared AS s ON b.key = s.key AND b.source IS NOT DISTINCT FROM s.source GROUP BY doc_id),
             dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM b GROUP BY doc_id),
             win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win
                     FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8) AS x),
             twice AS (SELECT doc_id, win FROM win GROUP BY ALL HAVING count(*) > 1),
             rep AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words
                     FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM win JOIN twice USING (doc_id, win)) AS y GROUP BY doc_id),
             base AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '{_CLASS}', '', 'g')) AS word_chars,
                             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                             coalesce(n_lines, 0) AS n_removed_lines, coalesce(n_gone, 0)::BIGINT AS n_removed_words
                      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
             f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
        SELECT *, NOT base_failed AND n_words - n_removed_words >= n_words * 0.3::DOUBLE AS kept FROM f""",
    "op12_prefix_trie": rf"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                              md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
                   FROM conversations WHERE conv_id IS NOT NULL),
             c AS (SELECT DISTINCT conv_id, {_crc("conv_id")} % 9 AS h, conv_id - conv_id % 5 AS base FROM t),
             r AS (SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.base AND i <= h
                   UNION ALL SELECT conv_id, i, role, text FROM t JOIN c USING (conv_id) WHERE i > h),
             s AS (SELECT conv_id, strlen(text) AS bytes, md5(strlen(role) || ':' || role || text) AS turn,
                          row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth FROM r),
             m AS (SELECT conv_id, depth, bytes, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM s
                   UNION ALL SELECT conv_id, 0, 0, '' FROM c),
             n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM m GROUP BY path, depth),
             kids AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
             fam AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (path)),
             sub AS (SELECT left(path, 32 * k) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
                     FROM (SELECT *, unnest(range(depth + 1)) AS k FROM fam) AS x GROUP BY ALL),
             ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS digest
                      FROM (SELECT * FROM m QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) AS x GROUP BY path)
        SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved::BIGINT AS saved_tokens,
               coalesce(digest, sha256('')) AS ends_sha256
        FROM fam AS f JOIN sub USING (path) LEFT JOIN ends USING (path)
        LEFT JOIN n AS p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.path = left(f.path, 32 * (f.depth - 1))""",
    "op13_merkle_manifest": rf"""
        WITH RECURSIVE
             f AS (SELECT doc_id, lang, text, {_crc("doc_id")} % 3 = 0 AS changed,
                          concat_ws('', {_field("doc_id")}, {_field("source")}, {_field("lang")}, {_field("n_chars")}) AS fixed FROM documents),
             l AS (SELECT *, sha256(fixed || {_field("text")}) AS leaf,
                          sha256(fixed || {_field(f"translate(text, '{UPPER}', '{LOWER}')")}) AS claimed FROM f),
             leaves AS (SELECT doc_id, lang, leaf, CASE WHEN changed THEN claimed ELSE leaf END AS claimed,
                               row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
             nodes(lang, level, pos, h, n) AS (
                 SELECT lang, 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM leaves
                 UNION ALL SELECT lang, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8
                           FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 8, n),
             subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM nodes WHERE n = 1),
             tops(level, pos, h, n) AS (
                 SELECT 0, pos, subroot, count(*) OVER () FROM subs
                 UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8
                           FROM tops WHERE n > 1 GROUP BY level, pos // 8, n),
             step AS (SELECT lang, level, pos, {_step("lang, level, pos // 8")} AS step FROM nodes WHERE n > 1),
             top_step AS (SELECT level, pos, {_step("level, pos // 8")} AS step FROM tops WHERE n > 1),
             low AS (SELECT v.lang, v.pos, list(step ORDER BY level) AS path FROM leaves AS v
                     JOIN step AS s ON s.lang IS NOT DISTINCT FROM v.lang AND s.pos = v.pos >> (3 * level) GROUP BY ALL),
             high AS (SELECT lang, list(step ORDER BY level) AS path FROM subs AS v JOIN top_step AS s ON s.pos = v.pos >> (3 * level) GROUP BY ALL),
             whole AS (SELECT v.*, subroot, coalesce(low.path, []) || coalesce(high.path, []) AS path
                       FROM leaves AS v JOIN subs ON subs.lang IS NOT DISTINCT FROM v.lang
                       LEFT JOIN low ON low.lang IS NOT DISTINCT FROM v.lang AND low.pos = v.pos
                       LEFT JOIN high ON high.lang IS NOT DISTINCT FROM v.lang),
             folded AS (SELECT *, list_reduce([claimed] || path, lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root,
                               (SELECT h FROM tops WHERE n = 1) AS root FROM whole)
        SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root,
               folded_root = root AS verified FROM folded""",
}
