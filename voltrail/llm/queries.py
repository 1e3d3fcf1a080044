"""Registered queries of the corpus operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voltrail.llm import (
    alignment, bpe, empirical_bayes, exact_dedup, filter_audit, html_text, jaccard, language, mixing, near_vectors, pstable_search, quality, url_filter, wordpiece,
)
from voltrail.llm.common import table, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run
    return register


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || left(md5(concat_ws(':', CAST(doc_id AS VARCHAR), text)), 15) AS BIGINT) AS u
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
                   3 * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS words FROM per),
levels AS (
  SELECT *, (words - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM weighed),
goals AS (
  SELECT *, least(CAST(cap AS DOUBLE), coalesce((SELECT arg_min(level, place) FROM levels WHERE cap / weight >= level)
                                               * weight, CAST(cap AS DOUBLE))) AS target FROM levels),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
           FROM goals),
points AS (SELECT source, u, sum(size) AS words FROM d GROUP BY source, u),
running AS (
  SELECT p.source, p.u, p.words, e.target - e.epochs * e.source_size AS rest,
         coalesce(sum(p.words) OVER (PARTITION BY p.source ORDER BY p.u
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM points p JOIN epochs e ON p.source IS NOT DISTINCT FROM e.source),
edges AS (SELECT source, arg_max(u + CASE WHEN (rest - below) * 2 > words THEN 1 ELSE 0 END, u) AS edge
          FROM running WHERE below <= rest GROUP BY source)
SELECT d.doc_id, d.size, e.source_size, e.target,
       CAST(d.size * (e.epochs + CASE WHEN d.u < g.edge THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN epochs e ON d.source IS NOT DISTINCT FROM e.source
JOIN edges g ON d.source IS NOT DISTINCT FROM g.source
"""


@query("op1_mix_sources", MIX_SQL)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 1, 2, 3 over the sources, all words of the corpus as the budget."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept, text_sha256
FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


@query("op4_exact_dedup", EXACT_SQL)
def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


#: Fixed rules of the query: host, start of the path, verdict.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def _shrunk_sql(level: str, parent: str, rate: str) -> str:
    """The posterior mean of a level's groups (n, bad) below their parent's rate, and the weight it rests on."""
    p = f"CAST({parent} AS DOUBLE)"
    low, high = repr(1 / (empirical_bayes.STRONGEST + 1)), repr(1 / (empirical_bayes.WEAKEST + 1))
    spread = f"sum(pow(bad - n * {p}, 2) - n * {p} * (1 - {p}))"
    room = f"sum(n * (n - 1) * {p} * (1 - {p}))"
    worth = f"(SELECT 1 / least(greatest(coalesce({spread} / CASE WHEN {room} > 0 THEN {room} END, 0), {low}), {high}) - 1 FROM {level})"
    return f"SELECT *, (bad + worth * {p}) / (n + worth) AS {rate}, n + worth AS weight FROM (SELECT *, {worth} AS worth FROM {level})"


def _url_sql() -> str:
    fits = [(f"(host = '{site}' OR ends_with(host, '.{site}')) AND starts_with(path, '{start}')", site + start, verdict)
            for site, start, verdict in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))]
    rule = " ".join(f"WHEN {test} THEN '{name}'" for test, name, _ in fits)
    verdict = " ".join(f"WHEN {test} THEN '{result}'" for test, _, result in fits)
    suffix = " ".join(f"WHEN host = '{x}' OR ends_with(host, '.{x}') THEN '{x}'" for x in url_filter.LONG_SUFFIXES)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    margin = f"{url_filter.DEVIATIONS} * sqrt(rate * (1 - rate) / (weight + 1))"
    return (
        r"WITH named AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), "
        rf"'{upper}', '{upper.lower()}') AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages), "
        f"ruled AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS ruled FROM named), "
        "counted AS (SELECT host, count(ruled) AS n, count(*) FILTER (WHERE ruled = 'block') AS bad FROM ruled GROUP BY host), "
        f"suffixed AS (SELECT *, CASE {suffix} ELSE string_split(host, '.')[-1] END AS suffix FROM counted), "
        "hosts0 AS (SELECT *, CASE WHEN len(string_split(host, '.')) <= len(string_split(suffix, '.')) + 1 THEN host ELSE "
        "array_to_string(string_split(host, '.')[-(len(string_split(suffix, '.')) + 1):], '.') END AS domain FROM suffixed), "
        "domains0 AS (SELECT suffix, domain, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM hosts0 GROUP BY 1, 2), "
        "suffixes0 AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM domains0 GROUP BY 1), "
        "suffixes1 AS (SELECT *, (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) FROM suffixes0) AS all_rate FROM suffixes0), "
        f"suffixes AS ({_shrunk_sql('suffixes1', 'all_rate', 'suffix_rate')}), "
        "domains1 AS (SELECT d.*, suffix_rate FROM domains0 d JOIN suffixes USING (suffix)), "
        f"domains AS ({_shrunk_sql('domains1', 'suffix_rate', 'domain_rate')}), "
        "hosts1 AS (SELECT h.*, domain_rate FROM hosts0 h JOIN domains USING (suffix, domain)), "
        f"hosts AS ({_shrunk_sql('hosts1', 'domain_rate', 'rate')}) "
        "SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN greatest(rate - "
        f"{margin}, 0) > {url_filter.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict FROM ruled r JOIN hosts h ON r.host = h.host"
    )


@query("op5_url_filter", _url_sql())
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op7_bpe")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against the ``tokenizers`` library."""
    return bpe.digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op6_token_counts")
def piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against the greedy search."""
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), *wordpiece.pieces_of(tokenizer_path("piece_bpe_32k.model")))


@query("op10_language")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested by its accuracy on held-out documents."""
    return language.identify(table(spark, sf_dir, "documents"))


@query("op9_near_vectors")
def near_duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of 0.95 or more. Tested against all pairs."""
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op2_html_text")
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against pages whose article is known."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op8_jaccard_join")
def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8. Tested against all pairs."""
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


@query("op3_quality")
def quality_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources, paths the languages within a source. Tested by its accuracy on labels it was not fitted on."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_pstable_search")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th id against all vectors. Tested by recall and against all pairs."""
    return pstable_search.search(table(spark, sf_dir, "embeddings"))


AUDIT_SQL = r"""
WITH marks AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
                 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
docs AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                concat(CASE WHEN len(words) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
                       CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END,
                       CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
                       CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
         FROM texts t LEFT JOIN marks m ON t.doc_id = m.doc_id),
counted AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM docs GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS f, '[' || filter_order[:step - 1] || '0]' AS before
          FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
lines AS (SELECT part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS failing, regexp_matches(fails, before) AS early FROM counted, steps),
summed AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (WHERE NOT failing AND NOT early), 0) AS kept,
                  coalesce(sum(n) FILTER (WHERE failing AND NOT early), 0) AS removed, coalesce(sum(n) FILTER (WHERE failing AND early), 0) AS redundant,
                  coalesce(sum(n) FILTER (WHERE fails = f), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE failing AND NOT early), 0) AS good_lost,
                  coalesce(sum(toxic) FILTER (WHERE failing AND NOT early), 0) AS toxic_lost FROM lines GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM summed
"""


@query("op12_filter_audit", AUDIT_SQL)
def filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all orders, for each language."""
    return filter_audit.audit(spark, sf_dir)


@query("op13_alignment")
def token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level against piece tokens. Tested against whole texts and all pairs of overlapping tokens."""
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
