"""The operators' queries over the supplied tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .blocks import exact_duplicates
from .common import table
from .fixity import FILE_RECORDS, archive, audit
from .jaccard import similar_classes
from .language import held_out_predictions
from .lengths import length_histogram, suffix_sums
from .licenses import scan_licenses
from .manifest import manifest
from .mixing import mix_sources
from .pieces import encode_documents
from .quality import score_quality
from .simhash import near_duplicates
from .sketch import versions
from .trie import prefix_trie


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of the pages with some bytes changed, and records lost or written twice at the ends of archive files."""
    at, file = F.col("page_id") % FILE_RECORDS, F.floor(F.col("page_id") / FILE_RECORDS)
    lost = (at >= FILE_RECORDS - 2) & (file % 7 == 2)
    twice = (at == FILE_RECORDS - 1) & (file % 11 == 4)
    changed = F.when(F.col("page_id") % 97 == 3, F.overlay("html", F.lit("#"), 2, 1)).otherwise(F.col("html"))
    copies = F.when(lost, 0).when(twice, 2).otherwise(1)
    there = pages.withColumn("html", changed).withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
    return there.drop("copy")


def op1_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return audit(archive(pages), archive(damaged(pages)))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(_documents(spark, sf_dir))


def op7_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(length_histogram(_documents(spark, sf_dir)))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_documents(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_predictions(_documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fixity": op1_fixity,
    "op2_licenses": op2_licenses,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_fingerprints": op6_fingerprints,
    "op7_token_lengths": op7_token_lengths,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_language": op9_language,
    "op10_quality": op10_quality,
    "op11_manifest": op11_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_jaccard_join": op13_jaccard_join,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _archive_sql(pages: str) -> str:
    """Records of an archive as the operator lays them out, from a table of pages."""
    return f"""
        SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY record_id, url, digest
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
        FROM (SELECT page_id // {FILE_RECORDS} AS file, page_id AS record_id, url,
                     strlen(record) AS length, sha256(record) AS digest
              FROM (SELECT page_id, url, replace('WARC/1.0|WARC-Type: resource|WARC-Record-ID: <urn:page:' || page_id
                           || '>|WARC-Target-URI: ' || url || '|Content-Type: text/html|Content-Length: '
                           || strlen(html) || '||', '|', chr(13) || chr(10)) || html
                           || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM {pages}))
    """


_DAMAGED = f"""
    (SELECT page_id, url, CASE WHEN page_id % 97 = 3 THEN left(html, 1) || '#' || substr(html, 3) ELSE html END AS html
     FROM pages, range(2) copy(n)
     WHERE n < CASE WHEN page_id % {FILE_RECORDS} >= {FILE_RECORDS} - 2 AND page_id // {FILE_RECORDS} % 7 = 2 THEN 0
                    WHEN page_id % {FILE_RECORDS} = {FILE_RECORDS} - 1 AND page_id // {FILE_RECORDS} % 11 = 4 THEN 2
                    ELSE 1 END)
"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text of ASCII characters; 3988292384 is its polynomial with the bits in reverse."""
    step = "CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END"
    table = f"list_transform(range(256), lambda b: list_reduce(range(8), lambda crc, i: {step}, b))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)"
    rest = f"list_reduce({codes}, lambda crc, code: xor(crc >> 8, ({table})[(xor(crc, code) & 255) + 1]), 4294967295)"
    return f"xor({rest}, 4294967295)"


def _manifest_sql() -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ['doc_id', 'source', 'lang', 'n_chars', text]))})"
    later = f"CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 5 = 0 AND text IS NOT NULL THEN {_LOWER} ELSE text END"
    levels = lambda leaves: f"""
          SELECT grp, 0 AS level, pos, n, digest FROM {leaves}
          UNION ALL
          SELECT grp, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
          FROM {leaves}_up WHERE n > 1 GROUP BY grp, level, pos // 16, n"""  # noqa: E731
    families = lambda leaves: f"""
          SELECT grp, level, pos // 16 AS parent, list(digest ORDER BY pos) AS kids
          FROM {leaves}_up WHERE n > 1 GROUP BY grp, level, pos // 16"""  # noqa: E731
    others = "kids[: (pos % 16)::INT] || kids[(pos % 16)::INT + 2 :]"
    changed = "kids[: (pos % 16)::INT] || [cur] || kids[(pos % 16)::INT + 2 :]"
    climb = lambda leaves, key, cur: f"""
          SELECT {key}, grp, 0 AS level, pos, {cur} AS cur, ''::VARCHAR AS beside FROM {leaves}
          UNION ALL
          SELECT {key}, c.grp, c.level + 1, parent, sha256(array_to_string({changed}, '')), beside || array_to_string({others}, '')
          FROM {leaves}_climb c JOIN {leaves}_families f ON f.grp = c.grp AND f.level = c.level AND f.parent = c.pos // 16"""  # noqa: E731
    return f"""
        WITH RECURSIVE leaves AS (
          SELECT doc_id, row_id, coalesce('=' || source, '') AS grp, digest, later,
                 row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos,
                 count(*) OVER (PARTITION BY source) AS n
          FROM (SELECT doc_id, row_number() OVER () AS row_id, source, {leaf('text')} AS digest, {leaf('later_text')} AS later
                FROM (SELECT *, {later} AS later_text FROM documents))),
        leaves_up AS ({levels("leaves")}),
        leaves_families AS MATERIALIZED ({families("leaves")}),
        tops AS (SELECT 0 AS grp, grp AS name, digest, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n
                 FROM leaves_up WHERE n = 1),
        tops_up AS ({levels("tops")}),
        tops_families AS MATERIALIZED ({families("tops")}),
        leaves_climb AS ({climb("leaves", "row_id", "later")}),
        tops_climb AS ({climb("tops", "name", "digest")}),
        top_proof AS (SELECT name, arg_max(beside, level) AS beside FROM tops_climb GROUP BY name),
        below AS (SELECT row_id, arg_max(beside, level) AS beside, arg_max(cur, level) AS cur FROM leaves_climb GROUP BY row_id),
        -- A changed source's root goes up the tree over the sources in its turn.
        kept_climb AS (
          SELECT row_id, t.grp, 0 AS level, t.pos, cur FROM below JOIN leaves USING (row_id) JOIN tops t ON t.name = leaves.grp
          UNION ALL
          SELECT row_id, c.grp, c.level + 1, parent, sha256(array_to_string({changed}, ''))
          FROM kept_climb c JOIN tops_families f ON f.grp = c.grp AND f.level = c.level AND f.parent = c.pos // 16),
        folds AS (SELECT row_id, arg_max(cur, level) AS folded_root FROM kept_climb GROUP BY row_id)
        SELECT doc_id, l.digest AS leaf, t.digest AS subroot, r.digest AS root,
               sha256(b.beside || p.beside) AS proof_sha256, folded_root, folded_root = r.digest AS verified
        FROM leaves l JOIN below b USING (row_id) JOIN folds USING (row_id) JOIN tops t ON t.name = l.grp
        JOIN top_proof p ON p.name = l.grp, (SELECT digest FROM tops_up WHERE n = 1) r
    """


_TRIE_SQL = rf"""
    WITH convs AS (
      SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS turns
      FROM conversations GROUP BY conv_id),
    rebuilt AS (
      SELECT c.conv_id, coalesce(b.turns[: h::INT], []) || c.turns[h::INT + 1 :] AS turns
      FROM (SELECT *, coalesce({_crc32_sql('conv_id::VARCHAR')} % 4, 0) AS h FROM convs) c
      LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20),
    steps AS (
      SELECT conv_id, len(turns) AS length, depth, sha256(to_json(turns[: depth])) AS node,
             CASE WHEN depth > 0 THEN sha256(to_json(turns[: depth - 1])) END AS parent,
             CASE WHEN depth > 0 THEN len(regexp_extract_all(turns[depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
      FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1))::INT AS depth FROM rebuilt)),
    nodes AS (
      SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             max(length) = any_value(depth) AS leaf, (count(*) - 1) * any_value(words) AS saved,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
      FROM steps GROUP BY node),
    -- A node's subtree: the nodes on whose smallest member's path it lies.
    sums AS (
      SELECT s.node, sum(saved) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves
      FROM nodes n JOIN steps s ON s.conv_id = n.conv_id AND s.depth <= n.depth GROUP BY s.node)
    SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs,
           (SELECT count(*) FROM nodes c WHERE c.parent = n.node) AS n_children,
           n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
    FROM nodes n JOIN sums USING (node) LEFT JOIN nodes p ON p.node = n.parent
"""

SQL: dict[str, str] = {
    "op12_prefix_trie": _TRIE_SQL,
    "op11_manifest": _manifest_sql(),
    "op1_fixity": f"""
        SELECT coalesce(a.file, b.file) AS file, coalesce(a."offset", b."offset") AS "offset",
               coalesce(a.record_id, b.record_id) AS record_id,
               CASE WHEN b.file IS NULL THEN 'missing' WHEN a.file IS NULL THEN 'extra' ELSE 'corrupt' END AS status,
               a.digest AS left_digest, b.digest AS right_digest
        FROM ({_archive_sql("pages")}) a
        FULL JOIN ({_archive_sql(_DAMAGED)}) b ON a.file = b.file AND a."offset" = b."offset"
        WHERE a.digest IS DISTINCT FROM b.digest
    """,
    "op3_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, {_LOWER} AS norm FROM documents)
        WINDOW same AS (PARTITION BY norm)
    """,
    "op4_mixing": r"""
        WITH sizes AS (
          SELECT doc_id, source, size, CASE WHEN size < 16 THEN 0 WHEN size < 256 THEN 1 ELSE 2 END AS boost, twin,
                 row_number() OVER (PARTITION BY twin) - 1 AS copy
          FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                       md5(coalesce('=' || source, '') || '|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS twin
                FROM documents)),
        sources AS (
          SELECT source, source_size, 3 * source_size AS most,
                 CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
          FROM (SELECT source, sum(size) AS source_size FROM sizes GROUP BY source)),
        shares AS (
          SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (filling ROWS BETWEEN UNBOUNDED PRECEDING
                    AND 1 PRECEDING), 0))::DOUBLE
                    / sum(weight) OVER (filling ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
          FROM sources WINDOW filling AS (ORDER BY most / weight, source NULLS LAST)),
        targets AS (
          SELECT source, source_size,
                 CASE WHEN share * weight > most THEN most::DOUBLE
                      ELSE max(share) FILTER (WHERE share * weight <= most) OVER () * weight END AS target
          FROM shares),
        classes AS (
          SELECT c.source, boost, words, target, source_size, pow(2.0, boost) AS times
          FROM (SELECT source, boost, sum(size) AS words FROM sizes GROUP BY source, boost HAVING sum(size) > 0) c
          JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
        rates AS (
          SELECT *, (target - 3 * coalesce(sum(words) OVER (heaviest ROWS BETWEEN UNBOUNDED PRECEDING
                    AND 1 PRECEDING), 0)::DOUBLE)
                    / sum(words * times) OVER (heaviest ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
          FROM classes WINDOW heaviest AS (PARTITION BY source ORDER BY boost DESC)),
        wanted AS (
          SELECT *, copies - floor(copies) AS chance, floor(copies) AS whole FROM (
            SELECT *, CASE WHEN rate * times >= 3 THEN 3.0::DOUBLE ELSE greatest(
                      max(rate) FILTER (WHERE rate * times < 3) OVER (PARTITION BY source) * times, 0.0) END AS copies
            FROM rates)),
        odds AS (
          SELECT *, CASE WHEN chance > 0 THEN chance / (1 - chance) END AS odds,
                 target - sum(whole * words) OVER (PARTITION BY source) AS rest FROM wanted),
        drawn AS (
          SELECT s.*, whole, rest, u / (1 - u) / odds AS q FROM (
            SELECT *, (('0x' || substr(draw, 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
            FROM (SELECT *, md5('mix:' || twin || ':' || copy) AS draw FROM sizes)) s
          LEFT JOIN odds o ON s.source IS NOT DISTINCT FROM o.source AND s.boost = o.boost),
        chosen AS (
          SELECT *, coalesce(q IS NOT NULL AND coalesce(sum(size) OVER (PARTITION BY source ORDER BY q / (1 + q) NULLS LAST,
                    draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                    + size / 2 <= rest, false) AS more
          FROM drawn)
        SELECT c.doc_id, size, source_size::BIGINT AS source_size, target,
               (coalesce(whole, 0) + more::INT)::BIGINT AS copies, (size * (coalesce(whole, 0) + more::INT))::BIGINT AS taken
        FROM chosen c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
    """,
}
