"""The driver's queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postflow.llm import (
    op01_sharding,
    op02_exact_dedup,
    op03_suffix_dedup,
    op04_language,
    op05_mixing,
    op06_near_dedup,
    op07_substring_dedup,
    op08_decontamination,
    op09_toxicity,
    op10_quality,
    op11_divergence,
    op12_url_filter,
    op13_conversation,
)
from postflow.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_sharding.shard_rows(table(spark, sf_dir, "documents"), shards=40)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=50)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_language.languages(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_mixing.allot(table(spark, sf_dir, "documents"), share=1.0, epochs=3).select(
        "doc_id", "size", "source_size", "target", "taken")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=20)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_divergence.divergence(table(spark, sf_dir, "documents"), least_docs=3, top=200)


# Host, path, verdict of the rules that the query applies.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return op12_url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_conversation.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_exact_dedup, op3_suffix_dedup, op4_language_id, op5_mixing, op6_near_dedup,
    op7_substring_dedup, op8_decontamination, op9_toxicity, op10_quality_classifier,
    op11_divergence_audit, op12_url_filters, op13_conversation_repair)}


def _state(of: str, cost: str, letter: str, line: str = "''") -> str:
    """SQL of a state of the repair after one more edit."""
    return f"{{'c': {of}.c + {cost}, 'a': {of}.a || '{letter}', 'r': {of}.r || {line}}}"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _when(role: str, of: str) -> str:
    """SQL of keeping a row of this role."""
    return f"CASE WHEN NOT gone AND ini = '{role}' THEN {_state(of, 'extra', 'K', 'chr(10) || role || chr(58) || text')} END"


def _reroled(role: str, of: str) -> str:
    return f"CASE WHEN NOT gone THEN {_state(of, '1 + extra', 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || text')} END"


def _inserted(role: str, of: str) -> str:
    return _state(of, "5", "I", f"chr(10) || '{role}:'")


ORACLES = {
    "op11_divergence_audit": r"""
        WITH d AS (
          SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        o AS (SELECT id, lang, source, unnest(w) AS term FROM d),
        k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 3),
        c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
        g AS (SELECT lang, source, coalesce(any_value(t.n), 0) AS n, coalesce(any_value(v.v), 0) AS v
              FROM (SELECT DISTINCT lang, source FROM d)
              LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) t USING (lang, source)
              LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY ALL) v USING (lang) GROUP BY ALL),
        l AS (SELECT lang, sum(n) AS n FROM g GROUP BY ALL),
        p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n,
                     1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (g.n + g.v)::HUGEINT AS p
              FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        q AS (SELECT lang, term, 1 + (1000000000 * (any_value(s) + 1)::HUGEINT) // (any_value(l.n) + count(*) OVER (PARTITION BY lang))::HUGEINT AS q
              FROM (SELECT lang, term, sum(n) AS s FROM c GROUP BY ALL) JOIN l USING (lang) GROUP BY lang, term),
        pairs AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(f.value), 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
                     FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
            ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
          GROUP BY a.lang, a.source, b.source),
        terms AS (
          SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
          FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
              FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT * FROM r WHERE part = 'pair' OR rank <= 200""",
    "op12_url_filters": r"""
        WITH u AS (SELECT page_id, strpos(coalesce(url, ''), '://') AS mark, url FROM pages),
        h AS (SELECT page_id, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest FROM u),
        s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM h),
        p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM s),
        r(h, f, v) AS (VALUES {rules}),
        b AS (SELECT page_id, host, path, arg_max({'rule': h || f, 'v': v}, length(h || f) * 1000 + length(h)) AS best
              FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f) GROUP BY ALL)
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM b"""
    .replace("{rules}", ", ".join(map(str, URL_RULES))),
    "op13_conversation_repair": rf"""
        WITH RECURSIVE t AS (
          SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc),
        b AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS g, conv_id, turn, coalesce(role, ' ') AS role,
                     coalesce(text, ' ') AS text,
                     coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
              FROM conversations),
        k AS (SELECT b.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
                     lambda x, c: xor(x >> 8, t.crc[1 + (xor(x, c) & 255)])), 4294967295) % 20 AS kind FROM b, t),
        m AS (SELECT g, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                     CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                     unnest(generate_series(1, CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
              FROM k WHERE kind <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
                     rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM m),
        f AS (SELECT *, shown = '' AS blank,
                     shown <> '' AND row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS dup,
                     right(shown, 1) NOT IN ('.', '!', '?') AS cut, left(role, 1) AS ini,
                     lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) AS prev FROM o),
        r AS (SELECT g, i, role, text, ini, blank OR dup AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS extra FROM f),
        dp AS (
          SELECT DISTINCT g, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS s0, {{'c': 999999::BIGINT, 'a': '', 'r': ''}} AS s1,
                 {{'c': 999999::BIGINT, 'a': '', 'r': ''}} AS s2, {{'c': 999999::BIGINT, 'a': '', 'r': ''}} AS s3 FROM b
          UNION ALL
          SELECT g, i, {_state('s0', '2', 'D')}, {_least(_state('s1', '2', 'D'), _when('s', 's0'))},
                 {_least(_state('u2', '2', 'D'), *(f(x, y) for f, x in ((_when, 'u'), (_reroled, 'user')) for y in ('s0', 's1', 'u3')))},
                 {_least(_state('u3', '2', 'D'), _when('a', 'u2'), _reroled('assistant', 'u2'))}
          FROM (SELECT x.*, {_least('s3', _inserted('assistant', 'u2'))} AS u3
                FROM (SELECT r.*, s0, s1, s2, s3, {_least('s2', *(_inserted('user', x) for x in ('s0', 's1', 's3')))} AS u2
                      FROM dp JOIN r ON r.g = dp.g AND r.i = dp.i + 1) x)),
        z AS (SELECT g, {_least('s3', _inserted('assistant', 'u2'), 's0')} AS best
              FROM (SELECT *, {_least('s2', *(_inserted('user', x) for x in ('s0', 's1', 's3')))} AS u2 FROM dp
                    QUALIFY i = max(i) OVER (PARTITION BY g))),
        n AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
                     count_if(dup) AS duplicate, count_if(NOT blank AND NOT dup AND cut) AS truncated,
                     count_if(prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, CAST(coalesce(n.blank, 0) AS BIGINT) AS blank,
               CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
               CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, best.c AS cost, best.a AS audit,
               sha256(substr(best.r, 2)) AS repaired_sha256
        FROM (SELECT DISTINCT g, conv_id FROM b) JOIN z USING (g) LEFT JOIN n USING (g)""",
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
               doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))""",
    "op3_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        w AS (SELECT doc_id, p, substr(x, 2 * p - 1, 100) AS bytes
              FROM (SELECT doc_id, x, unnest(generate_series(1, length(x) // 2 - 49)) AS p FROM d)),
        f AS (SELECT bytes, min(doc_id) AS first FROM w GROUP BY bytes),
        h AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 AS joined
              FROM w JOIN f USING (bytes) WHERE first < doc_id),
        i AS (SELECT doc_id, p, count_if(joined IS DISTINCT FROM true) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM h),
        s AS (SELECT doc_id, min(p) AS lo, max(p) + 49 AS hi FROM i GROUP BY doc_id, run),
        g AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM s),
        k AS (SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (lo - 1 - before)), '' ORDER BY lo) AS head,
                     max(hi) AS done, CAST(sum(hi - lo + 1) AS BIGINT) AS n_removed, count(*) AS n_spans
              FROM g JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(done, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op5_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, md5('5:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS turn,
                 coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
          FROM documents),
        s AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight
          FROM d GROUP BY source),
        f AS (
          SELECT *, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS words,
                 coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source ASC NULLS LAST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
                 sum(weight) OVER (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source ASC NULLS LAST
                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
          FROM s),
        l AS (SELECT *, (words - CAST(clamped AS DOUBLE)) / CAST(open AS DOUBLE) AS level FROM f),
        b AS (SELECT arg_min(level, clamped) AS level FROM l WHERE weight * level <= cap),
        t AS (SELECT l.source, l.source_size, least(CAST(cap AS DOUBLE), weight * b.level) AS target FROM l, b),
        r AS (
          SELECT d.doc_id, d.size, t.source_size, t.target,
                 CAST(floor(t.target) AS BIGINT) AS goal,
                 CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS whole,
                 coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY turn, doc_id, size
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(whole * size + least(greatest(goal - whole * source_size - ahead, 0), size) AS BIGINT) AS taken
        FROM r""",
    "op6_near_dedup": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[p: p + 3], ' ') AS shingle
              FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS p FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        e AS (SELECT a.doc_id AS a, b.doc_id AS b
              FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
              JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
              WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
              GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
        c AS (SELECT doc_id, doc_id AS other FROM documents
              UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.other = e.a),
        m AS (SELECT doc_id, min(other) AS component_id FROM c GROUP BY doc_id)
        SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept
        FROM m LEFT JOIN n ON n.doc_id = m.doc_id""",
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        v AS (SELECT doc_id, p, array_to_string(w[p: p + 19], ' ') AS win
              FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS p FROM d)),
        t AS (SELECT doc_id, p FROM v QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1),
        h AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 20 AS joined FROM t),
        i AS (SELECT doc_id, p, count_if(joined IS DISTINCT FROM true) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM h),
        s AS (SELECT doc_id, min(p) AS lo, max(p) + 19 AS hi FROM i GROUP BY doc_id, run),
        g AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM s),
        k AS (SELECT doc_id, flatten(list(w[before + 1: lo - 1] ORDER BY lo)) AS head, max(hi) AS done,
                     CAST(sum(hi - lo + 1) AS BIGINT) AS n_removed
              FROM g JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(array_to_string(coalesce(head, []) || w[coalesce(done, 0) + 1:], ' ')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op8_decontamination": r"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        i AS (
          SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p: p + least(len(w), 10) - 1], ' ') AS win
          FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM b WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT n FROM i),
        g AS (
          SELECT doc_id, p, n, array_to_string(w[p: p + n - 1], ' ') AS win
          FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, lengths WHERE len(w) >= n)),
        h AS (SELECT doc_id, p, n, item_id FROM g JOIN i USING (n, win)),
        c AS (SELECT doc_id, count(DISTINCT q) AS n_hit
              FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM h) GROUP BY doc_id),
        k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)""",
}
