"""The operators applied to the tables of a data folder, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.llm import bpe, class_lm, decontam, exact_dedup, jaccard_join, langid, licenses, mixing, quality, repair, toxicity, trie, warc
from portolan.llm.textio import documents, held_out, spread, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: classes and numbers of links at 5 words and 0.8."""
    return jaccard_join.ngram_jaccard_join(spread(documents(spark, sf_dir, "doc_id", "text")))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(spread(documents(spark, sf_dir, "doc_id", "text")), tokenizer_path())


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(documents(spark, sf_dir, "doc_id", "text", "lang"))
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", held_out("doc_id", 5).alias("held_out"), "lang_pred", "score", "n_words")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(spread(documents(spark, sf_dir, "doc_id", "text")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(documents(spark, sf_dir, "doc_id", "text"))
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id", 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *toxicity.KINDS)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spread(documents(spark, sf_dir, "doc_id", "text", "lang")), table(spark, sf_dir, "labels"))


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(spread(documents(spark, sf_dir, "doc_id", "text")))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's response, metadata and conversion record; ``content``: the fields or the text of what is derived (the response's is the page)."""
    records = warc.derivatives(warc.responses(spread(table(spark, sf_dir, "pages", "page_id", "url", "html"))))
    content = F.when(F.col("warc_type") != "response", F.col("block").cast("string")).alias("content")
    return records.select(F.col("doc").cast("bigint").alias("page_id"), *[c for c in records.columns if c not in ("doc", "block")], content)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(spread(documents(spark, sf_dir, "doc_id", "text")), table(spark, sf_dir, "benchmark"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir, "doc_id", "text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the damaged table: its faults, the cheapest edits and the digest of the repaired turns."""
    return repair.repair_of_damaged(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents at the weights 5, 2, 1: the words of each that the mix takes."""
    return mixing.shares(spread(documents(spark, sf_dir, "doc_id", "text", "source")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ngram_jaccard_join, op2_bpe_round_trip, op3_language_id, op4_license_scan, op5_toxicity, op6_quality, op7_class_lm, op8_warc_derivatives, op9_benchmark_decontamination, op10_exact_dedup, op11_conversation_repair, op12_prefix_trie, op13_source_mix)
}


#: The table of CRC-32, for ``_crc32``.
_BITS = """bits AS (
            SELECT list(list_reduce([k, 0, 1, 2, 3, 4, 5, 6, 7], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY k) AS tab
            FROM range(256) AS r(k))"""


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text, beside the row of ``bits``."""
    codes = f"[ascii(x)::BIGINT FOR x IN string_split({text}, '')]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda acc, b: xor(acc >> 8, tab[(xor(acc, b) & 255) + 1])), 4294967295)"


def _trie_sql() -> str:
    """The trie by each rebuilt conversation's digests in a row: a node is a prefix, and counts for all of its own prefixes."""
    return f"""
        WITH {_BITS},
        placed AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place,
                   sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS bytes
            FROM conversations),
        convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, coalesce({_crc32("coalesce(conv_id::VARCHAR, '0')")} % 9, 0) AS h FROM (SELECT DISTINCT conv_id FROM conversations), bits),
        rebuilt AS (
            SELECT c.conv_id, 0 AS own, t.place, t.digest, t.bytes FROM convs c JOIN placed t ON t.conv_id = c.base AND t.place <= c.h
            UNION ALL
            SELECT c.conv_id, 1, t.place, t.digest, t.bytes FROM convs c JOIN placed t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND (t.place > c.h OR c.conv_id IS NULL)),
        steps AS (
            SELECT conv_id, bytes, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS prefix, count(*) OVER (PARTITION BY conv_id) AS length
            FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, place ROWS UNBOUNDED PRECEDING)
            UNION ALL
            SELECT c.conv_id, 0, 0, '', (SELECT count(*) FROM rebuilt r WHERE r.conv_id IS NOT DISTINCT FROM c.conv_id) FROM convs c),
        nodes AS (
            SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
            FROM steps GROUP BY prefix, depth),
        children AS (SELECT left(prefix, 64 * (depth - 1)) AS above, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
        known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.prefix = c.above),
        subtrees AS (
            SELECT left(prefix, 64 * k) AS top, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * bytes)::BIGINT AS saved_tokens
            FROM (SELECT *, unnest(range(depth + 1)) AS k FROM known) GROUP BY ALL)
        SELECT k.conv_id, k.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n AS n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
        FROM known k JOIN subtrees s ON k.prefix = s.top LEFT JOIN nodes p ON k.depth > 0 AND p.prefix = left(k.prefix, 64 * (k.depth - 1))
    """


def _repair_sql() -> str:
    """The repair as a recursion over the places of a conversation: the least (cost, audit, text) of each symbol behind each turn."""

    def step(value: str, cost: str, edit: str, line: str = "''") -> str:
        return f"CASE WHEN {value} IS NOT NULL THEN {{'c': {value}.c + {cost}, 'a': {value}.a || '{edit}', 'r': {value}.r || {line}}} END"

    def least(*values: str) -> str:
        return f"list_min(list_filter([{', '.join(values)}], lambda x: x IS NOT NULL))"

    nl = "chr(10)"
    line = lambda role: f"({role} || ':' || t.text || {nl})"
    insert = lambda value, role: step(value, "3", "I", f"('{role}:' || {nl})")
    take = lambda value, initial, role: f"CASE WHEN NOT t.gone THEN CASE WHEN t.initial = '{initial}' THEN {step(value, 't.extra', 'K', line('t.role'))} ELSE {step(value, '3 + t.extra', 'R', line(repr(role)))} END END"
    system = f"CASE WHEN NOT t.gone AND t.initial = 's' THEN {step('p.z', 't.extra', 'K', line('t.role'))} END"
    gone = lambda value: step(value, "4", "D")
    return f"""
        WITH RECURSIVE {_BITS},
        hits AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS hit
            FROM conversations, bits),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
            FROM hits, range(2) AS c(copy) WHERE hit <> 0 AND (copy = 0 OR hit = 3)),
        placed AS (
            SELECT *, substr(role, 1, 1) AS initial, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS bare,
                   row_number() OVER w AS place, lag(substr(role, 1, 1)) OVER w AS before
            FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text))),
        judged AS (
            SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed),
        turns AS (SELECT *, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS extra FROM judged),
        counted AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                   count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (place > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM turns GROUP BY conv_id),
        columns_ AS (
            SELECT conv_id, 0::BIGINT AS place, {{'c': 0, 'a': '', 'r': ''}} AS z, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR) AS s, {{'c': 3, 'a': 'I', 'r': 'user:' || {nl}}} AS u,
                   {{'c': 6, 'a': 'II', 'r': 'user:' || {nl} || 'assistant:' || {nl}}} AS p
            FROM counted
            UNION ALL
            SELECT conv_id, place, z, s, u, {least('p', insert('u', 'assistant'))} AS p FROM (
                SELECT conv_id, place, z, s, {least('u', insert('z', 'user'), insert('s', 'user'), insert('p', 'user'))} AS u, p FROM (
                    SELECT conv_id, place, z, s, u, {least('p', insert('u', 'assistant'))} AS p FROM (
                        SELECT t.conv_id, t.place, {gone('p.z')} AS z, {least(gone('p.s'), system)} AS s,
                               {least(gone('p.u'), *(take(f'p.{x}', 'u', 'user') for x in 'zsp'))} AS u, {least(gone('p.p'), take('p.u', 'a', 'assistant'))} AS p
                        FROM columns_ p JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.place = p.place + 1)))),
        best AS (
            SELECT c.conv_id, {least('z', 'p')} AS b FROM columns_ c JOIN counted n ON c.conv_id IS NOT DISTINCT FROM n.conv_id AND c.place = n.n)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(left(b.r, length(b.r) - 1), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN counted ON o.conv_id IS NOT DISTINCT FROM counted.conv_id LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id
    """


ORACLE_SQL: dict[str, str] = {
    "op11_conversation_repair": _repair_sql(),
    "op12_prefix_trie": _trie_sql(),
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY sha256(coalesce(text, '')))
    """,
    "op13_source_mix": r"""
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   md5(concat(coalesce(doc_id::VARCHAR, ''), ':', coalesce(text, ''))) AS key
            FROM documents),
        sums AS (
            SELECT source, sum(size)::HUGEINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight
            FROM sized GROUP BY source),
        levels AS (
            SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
                   coalesce(sum(source_size) OVER w, 0) AS size_before, coalesce(sum(weight) OVER w, 0) AS weight_before
            FROM sums WINDOW w AS (ORDER BY source_size / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        judged AS (SELECT *, 3 * source_size * (all_weight - weight_before) < (total - 3 * size_before) * weight AS full_up FROM levels),
        aims AS (
            SELECT source, source_size::BIGINT AS source_size,
                   CASE WHEN full_up THEN (3 * source_size)::DOUBLE
                        ELSE least((3 * source_size)::DOUBLE, (weight * (total - 3 * coalesce(sum(source_size) FILTER (full_up) OVER (), 0)))::DOUBLE
                                   / (all_weight - coalesce(sum(weight) FILTER (full_up) OVER (), 0))::DOUBLE) END AS target
            FROM judged),
        spent AS (
            SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS passes FROM aims),
        placed AS (
            SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM sized)
        SELECT doc_id, p.source, size, source_size, target, passes,
               (passes * size + greatest(0, least(size, budget - passes * source_size - before)))::BIGINT AS taken
        FROM placed p JOIN spent s ON p.source IS NOT DISTINCT FROM s.source
    """,
}
