"""The engine's own queries by name, and SQL with the same result where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.functions import pii
from loomsift.functions.text import approximate_tokens, repaired, strip
from loomsift.operators import ranking, repair, reports, rules, selection, splits, stats
from loomsift.operators import records as rec
from loomsift.plans import sql
from loomsift.sources import jsonl
from loomsift.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def _found(s: SparkSession, d: str) -> DataFrame:
    """The findings of every rule over every record of the four tables."""
    return rules.findings(rec.all_records(s, d))


def _of(name: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        records = rec.all_records(s, d)
        found = rules.duplicates(records) if name == "duplicates" else rules.record_findings(records, [name])
        return found.select("file", "line_no", "idx", "kind")

    return run


for _name, _rule, _cte in (
    ("check_schema", "schema", "r_schema"), ("check_roles", "roles", "r_roles"), ("check_empty", "empty-content", "r_empty"), ("check_duplicates", "duplicates", "r_duplicates"),
    ("check_encoding", "encoding", "r_encoding"), ("check_preference", "preference", "r_preference"), ("check_secrets", "secrets", "r_secrets"), ("check_pii", "pii", "r_pii"),
):
    QUERIES[_name] = _of(_rule)
    if _cte:
        ORACLE[_name] = sql.over_records(f"SELECT file, line_no, CAST(idx AS BIGINT) AS idx, kind FROM {_cte}")


@query(sql.over_records("SELECT file, line_no, tokens FROM tokens WHERE tokens > 512"))
def check_context_window(s, d):
    """Records over a window of 512 tokens."""
    return rules.record_tokens(rec.all_records(s, d)).where("tokens > 512")


_EVAL = "e AS (SELECT * FROM prompted WHERE split IN ('dev', 'test') AND file IN ('clean', 'alpaca_clean')), t AS (SELECT * FROM prompted WHERE split = 'train' AND file IN ('clean', 'alpaca_clean'))"
_OVERLAP = f"""SELECT t.file, t.line_no, CASE WHEN f.line IS NOT NULL THEN 'full' ELSE 'prompt' END AS match, coalesce(f.line, p.line) AS eval_line
FROM t LEFT JOIN (SELECT full_key, min(line_no) AS line FROM e GROUP BY 1) f ON t.full_key = f.full_key
LEFT JOIN (SELECT prompt_key, min(line_no) AS line FROM e WHERE prompt_key IS NOT NULL GROUP BY 1) p ON t.prompt_key = p.prompt_key WHERE f.line IS NOT NULL OR p.line IS NOT NULL"""


def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    both = rec.all_records(s, d).where(F.col("file").isin("clean", "alpaca_clean"))
    return both.where("split = 'train'"), both.where("split in ('dev', 'test')")


@query(f"WITH {sql.RECORDS.strip()}, {_EVAL}\n{_OVERLAP}")
def check_eval_overlap(s, d):
    """Training records that stand in the held-out splits."""
    return rules.overlap(*_sides(s, d))


@query(f"WITH {sql.RECORDS.strip()}, {_EVAL}\nSELECT t.file, t.line_no FROM t WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.full_key = t.full_key) AND NOT EXISTS (SELECT 1 FROM e WHERE e.prompt_key = t.prompt_key)")
def fix_eval_drop(s, d):
    """Training records that stand in no held-out split."""
    training, held_out = _sides(s, d)
    return repair.without_overlap(training, held_out).select("file", "line_no")


@query(sql.over_records("SELECT rule_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM finding GROUP BY 1"))
def issues_by_rule(s, d):
    """Findings by rule and severity."""
    return reports.by_rule(_found(s, d))


@query(sql.over_records("SELECT file, count(DISTINCT line_no) FILTER (severity = 'error') AS error_lines, count(DISTINCT line_no) FILTER (severity = 'warning') AS warning_lines FROM finding GROUP BY 1"))
def affected_lines(s, d):
    return reports.affected_lines(_found(s, d))


@query(sql.over_records("SELECT file, line_no, severity, rule_id, idx, kind FROM (SELECT * FROM finding ORDER BY severity, line_no, rule_order, idx NULLS FIRST, file, kind LIMIT 200)"))
def issues_in_order(s, d):
    """The first 200 findings in report order."""
    return reports.ordered(_found(s, d), 200).select("file", "line_no", "severity", "rule_id", "idx", "kind")


@query(sql.over_records("SELECT file, line_no FROM rec WHERE NOT EXISTS (SELECT 1 FROM finding f WHERE f.file = rec.file AND f.line_no = rec.line_no AND severity = 'error')"))
def clean_lines(s, d):
    """Records without an error."""
    return reports.valid_lines(rec.all_records(s, d), _found(s, d))


@query(sql.over_records("SELECT r.file, CAST(coalesce(max(CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END), 0) AS BIGINT) AS exit_code FROM (SELECT DISTINCT file FROM rec) r LEFT JOIN finding f ON f.file = r.file GROUP BY 1"))
def exit_codes(s, d):
    return reports.exit_codes(rec.all_records(s, d), _found(s, d))


@query(sql.over_records("SELECT file, line_no, CAST(bit_or(CAST(1 AS BIGINT) << rule_order) AS BIGINT) AS rules FROM finding GROUP BY ALL"))
def rule_masks(s, d):
    return reports.snapshot(_found(s, d))


_RATES = """total AS (SELECT file, count(*) AS total FROM rec GROUP BY 1),
lines AS (SELECT file, count(DISTINCT line_no) FILTER (severity = 'error') AS e, count(DISTINCT line_no) FILTER (severity = 'warning') AS w FROM finding GROUP BY 1),
copies AS (SELECT file, sum(n - 1) AS c FROM first WHERE n > 1 GROUP BY 1)
SELECT t.file, t.total, round(1 - coalesce(e, 0) / t.total, 9) AS clean_fraction, round(coalesce(e, 0) / t.total, 9) AS error_rate, round(coalesce(w, 0) / t.total, 9) AS warning_rate, round(CAST(coalesce(c, 0) AS DOUBLE) / t.total, 9) AS duplicate_rate
FROM total t LEFT JOIN lines USING (file) LEFT JOIN copies USING (file)"""


@query(f"WITH {sql.RECORDS.strip()}, {_RATES}")
def report_rates(s, d):
    """Shares of clean, faulty and redundant records by file."""
    out = reports.rates(rec.all_records(s, d), _found(s, d))
    return out.select("file", "total", *(F.round(c, 9).alias(c) for c in ("clean_fraction", "error_rate", "warning_rate", "duplicate_rate")))


@query()
def regressions(s, d):
    """Rates of the held-out rows of clean against those of its training rows."""
    records = rec.chat(table(s, d, "clean"))
    now, before = records.where("split in ('dev', 'test')"), records.where("split = 'train'")
    return reports.regressions(reports.rates(now, rules.findings(now)), reports.rates(before, rules.findings(before)))


@query(sql.over_records("SELECT source_format, count(*) AS records FROM rec GROUP BY 1"))
def records_by_format(s, d):
    return reports.by_format(rec.all_records(s, d))


@query(sql.over_records("SELECT coalesce(left(role, 40), 'invalid') AS role, count(*) AS messages FROM slot WHERE side = '' GROUP BY 1"))
def role_histogram(s, d):
    return reports.role_histogram(rec.all_records(s, d))


@query(sql.over_records("SELECT file, CAST(min(len(messages)) AS BIGINT) AS fewest, CAST(floor(quantile_cont(len(messages), 0.5)) AS BIGINT) AS middle, CAST(max(len(messages)) AS BIGINT) AS most, count(*) FILTER (messages[-1].role = 'assistant') AS end_on_assistant FROM rec WHERE len(messages) > 0 GROUP BY 1"))
def turn_stats(s, d):
    return reports.turn_stats(rec.all_records(s, d))


@query(sql.over_records("SELECT file, count(*) AS records, count(*) FILTER (tokens > 256) AS over, count(*) FILTER (tokens >= 0.85 * 256 AND tokens <= 256) AS at_risk, CAST(floor(quantile_cont(tokens, 0.5)) AS BIGINT) AS middle, max(tokens) AS largest FROM tokens GROUP BY 1"))
def token_stats(s, d):
    return reports.token_stats(rec.all_records(s, d), 256)


@query(sql.over_records("SELECT file, count(*) AS clusters, CAST(sum(n - 1) AS BIGINT) AS redundant, max(n) AS largest FROM first WHERE n > 1 GROUP BY 1"))
def duplicate_stats(s, d):
    return reports.duplicate_stats(rec.all_records(s, d))


_SLOTS = "SELECT line_no, side, CAST(idx AS BIGINT) AS idx, role, content FROM slot WHERE file = "


def _slots_of(shape, name: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        return rec.slots(shape(table(s, d, name))).select("line_no", "side", "idx", "role", "content")

    return run


for _name, _shape, _table in (("normalize_chat", rec.chat, "clean"), ("normalize_sharegpt", rec.turns, "sharegpt_clean"), ("normalize_alpaca", rec.instructions, "alpaca_clean"), ("normalize_preference", rec.preferences, "preference_clean")):
    QUERIES[_name] = _slots_of(_shape, _table)
    ORACLE[_name] = sql.over_records(f"{_SLOTS}'{_table}'")


@query(sql.over_records("SELECT file, line_no, CAST(cut AS INT) AS prompt_end, len(messages) AS messages FROM prompted WHERE messages IS NOT NULL"))
def prompt_slices(s, d):
    """Where the prompt of each record ends."""
    some = rec.all_records(s, d).where("messages is not null")
    return some.select("file", "line_no", rec.prompt_end(F.col("messages"), F.col("prompt_len")).alias("prompt_end"), F.size("messages").cast("bigint").alias("messages"))


@query(sql.over_records("SELECT file, line_no, side, len(turns) AS turns FROM side"))
def conversation_sides(s, d):
    return rec.sides(rec.all_records(s, d)).select("file", "line_no", "side", F.size("turns").cast("bigint").alias("turns"))


@query(sql.over_records(f"SELECT file, line_no, side, CAST(idx AS BIGINT) AS idx, {sql.repaired('content')} AS content FROM slot WHERE {sql.repaired('content')} <> content"))
def fix_encoding(s, d):
    """Texts that the encoding repair changes."""
    return rec.slots(rec.all_records(s, d)).withColumn("mended", repaired(F.col("content"))).where("mended <> content").select("file", "line_no", "side", "idx", F.col("mended").alias("content"))


@query(sql.over_records("SELECT k.file, k.line_no FROM keyed k JOIN first f ON k.file = f.file AND k.full_key = f.full_key AND k.line_no = f.first_line"))
def fix_dedupe(s, d):
    """The first line of each content."""
    return repair.deduplicated(rec.all_records(s, d)).select("file", "line_no")


_FULL = f"(m.content IS NULL OR {sql.strip('m.content')} <> '')"


@query(sql.over_records(f"SELECT file, line_no, len(list_filter(messages, lambda m: {_FULL})) AS messages, len(list_filter(rejected, lambda m: {_FULL})) AS rejected FROM rec WHERE messages IS NOT NULL AND len(list_filter(messages, lambda m: {_FULL})) > 0 AND (rejected IS NULL OR len(list_filter(rejected, lambda m: {_FULL})) > 0)"))
def fix_drop_empty(s, d):
    """Messages left of each record once empty ones are gone; records with an empty side are out."""
    kept = repair.drop_empty(rec.all_records(s, d)).where("messages is not null")
    return kept.select("file", "line_no", F.size("messages").cast("bigint").alias("messages"), F.when(F.col("rejected").isNotNull(), F.size("rejected")).cast("bigint").alias("rejected"))


@query()
def fix_truncate(s, d):
    """Records over 256 tokens cut down at their longest user message."""
    some = rec.all_records(s, d)
    long = some.join(rules.record_tokens(some).where("tokens > 256").select("file", "line_no"), ["file", "line_no"], "left_semi")
    cut = repair.truncate_longest(long, 256)
    return cut.select("file", "line_no", rules.side_tokens(F.col("messages")).alias("tokens"))


@query()
def fix_outcomes(s, d):
    """What becomes of every record that is not held out: unchanged, fixed or dropped, and by which rules."""
    _, held_out = _sides(s, d)
    own = rec.all_records(s, d).where("split is null or split not in ('dev', 'test')")
    return repair.fixed(own, held_out).select("file", "line_no", "disposition", "rules_fixed", "rules_unfixable")


@query()
def fix_counts(s, d):
    return reports.outcome_counts(fix_outcomes(s, d))


@query()
def fixes_by_rule(s, d):
    return reports.fixes_by_rule(fix_outcomes(s, d))


@query(sql.over_records("SELECT file, line_no, side, CAST(idx AS BIGINT) AS idx, x.kind AS kind, x.v AS value, CASE WHEN x.kind = 'email address' THEN left(x.v, 1) || '***@***.' || string_split(x.v, '.')[-1] ELSE '…' || right(regexp_replace(x.v, '[^0-9]', '', 'g'), 4) END AS mask FROM kept k JOIN named n ON k.id = n.id"))
def pii_values(s, d):
    """Personal data at their places, and what a report may show of them."""
    each = rec.slots(rec.all_records(s, d)).withColumn("found", pii.found(F.col("content"))).where("found is not null")
    each = each.select("file", "line_no", "side", "idx", F.explode("found").alias("f")).select("file", "line_no", "side", "idx", "f.kind", "f.value")
    return each.withColumn("mask", pii.masked(F.col("kind"), F.col("value")))


@query(sql.over_records(f"SELECT file, line_no, side, CAST(idx AS BIGINT) AS idx, redacted FROM redacted", sql.REDACTED))
def pii_redacted(s, d):
    """Texts with personal data replaced."""
    each = rec.slots(rec.all_records(s, d)).withColumn("redacted", pii.redacted(F.col("content"))).where("redacted <> content")
    return each.select("file", "line_no", "side", "idx", "redacted")


@query("SELECT line_no, file_name, 'sha256:' || left(sha256(raw), 32) AS record_id FROM raw_lines")
def record_ids(s, d):
    return table(s, d, "raw_lines").select("line_no", "file_name", splits.record_id(F.col("raw")).alias("record_id"))


@query("SELECT line_no, file_name, json_valid(raw) AS parsed FROM raw_lines")
def jsonl_parsed(s, d):
    """Which lines are JSON."""
    parsed = jsonl.parse(table(s, d, "raw_lines").select(F.col("file_name").alias("file"), "line_no", "raw"))
    return parsed.select("line_no", F.col("file").alias("file_name"), F.col("parse_error").isNull().alias("parsed"))


@query()
def jsonl_records(s, d):
    """Canonical messages of JSON lines, by detected shape."""
    parsed = jsonl.parse(table(s, d, "raw_lines").select(F.col("file_name").alias("file"), "line_no", "raw"))
    return rec.slots(parsed)


@query("""WITH t AS (SELECT doc_id, lang, sha256('7:' || doc_id) AS h, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || doc_id)) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN n >= 2 THEN CASE WHEN r <= least(n - 1, greatest(1, round_even(n * 0.5, 0))) THEN 'selection' ELSE 'comparison' END END AS half FROM t""")
def split_dev_halves(s, d):
    return splits.split_halves(table(s, d, "documents"), "lang", "doc_id")


@query("""WITH r AS (SELECT doc_id, lang, sha256(text) AS h FROM documents WHERE text IS NOT NULL),
k AS (SELECT lang, h, row_number() OVER (PARTITION BY lang ORDER BY h) AS n FROM (SELECT DISTINCT lang, h FROM r)),
c AS (SELECT lang, h, CASE WHEN n <= 5 THEN 'test' ELSE 'dev' END AS part FROM k WHERE n <= 10)
SELECT r.doc_id, r.lang, coalesce(c.part, 'train') AS part FROM r LEFT JOIN c ON r.h = c.h AND r.lang IS NOT DISTINCT FROM c.lang WHERE c.part IS NOT NULL OR r.h NOT IN (SELECT h FROM c)""")
def split_by_prompt_hash(s, d):
    """The split by prompts; the whole text is the prompt."""
    return splits.split_by_prompt(table(s, d, "documents").select("doc_id", "lang", "text"), "lang", "text", "doc_id", 5, 5)


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS r, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM documents) WHERE r <= round_even(n * (200.0::DOUBLE / total), 0)""")
def category_cap(s, d):
    """Documents cut to about 200, each source to its share."""
    return splits.capped(table(s, d, "documents"), "source", "doc_id", 200)


_P, _A = sql.strip("instruction"), sql.strip("output")


@query(f"SELECT min(line_no) AS line_no FROM alpaca_clean WHERE {_P} <> '' AND {_A} <> '' GROUP BY {_P}, {_A}")
def first_seen_pairs(s, d):
    return splits.first_seen(table(s, d, "alpaca_clean"), "line_no", "instruction", "output")


def _instruction_sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(s, d, "alpaca_clean").select("line_no", "split", "source", F.col("instruction").alias("text"))
    return rows.where("split = 'train'"), rows.where("split in ('dev', 'test')")


_WORDS = "list_filter(regexp_split_to_array(lower(t), '[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> '')"
_NEAR = f"""x AS (SELECT CASE WHEN split = 'train' THEN 'a' ELSE 'b' END AS side, lower(instruction) AS t, min(line_no) AS k FROM alpaca_clean WHERE instruction IS NOT NULL AND split IN ('train', 'dev', 'test') GROUP BY ALL),
g AS (SELECT side, k, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM (SELECT side, k, {_WORDS} AS w FROM x)),
u AS (SELECT side, k, len(s) AS n, unnest(s) AS z FROM g),
near AS (SELECT a.k AS left_key, b.k AS right_key, count(*) / (a.n + b.n - count(*)) AS similarity FROM u a JOIN u b ON a.z = b.z AND a.side = 'a' AND b.side = 'b' GROUP BY a.k, b.k, a.n, b.n)"""


@query(f"WITH {_NEAR} SELECT left_key, right_key, round(similarity, 6) AS similarity FROM near WHERE similarity >= 0.8")
def near_duplicate_links(s, d):
    """Training instructions and held-out ones whose five-word shingles are alike."""
    return splits.near_duplicates(*_instruction_sides(s, d), "line_no", "text").withColumn("similarity", F.round("similarity", 6))


@query()
def leakage_findings(s, d):
    return splits.leakage(*_instruction_sides(s, d), "line_no", "text")


@query()
def leakage_counts(s, d):
    return splits.leakage_counts(leakage_findings(s, d))


@query()
def related_leakage(s, d):
    """English documents, by language tags in any case, against all others, related by their source."""
    docs = table(s, d, "documents").select("doc_id", "text", "source", "lang")
    english = F.lower("lang").eqNullSafe(F.lit("en"))
    return splits.leakage(docs.where(english), docs.where(~english), "doc_id", "text", "source")


def _items(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("text is not null")
    return docs.select(F.col("doc_id").alias("id"), approximate_tokens(F.col("text")).alias("tokens"), "lang", "source", F.length("text").cast("double").alias("utility"))


@query()
def select_random(s, d):
    return selection.random_fill(_items(s, d), 20_000)


@query()
def select_by_utility(s, d):
    return selection.utility_fill(_items(s, d), 50_000)


@query()
def select_covered(s, d):
    return selection.covered_fill(_items(s, d), 50_000, "lang", {"de": 5, "fr": 5})


@query("""WITH i AS (SELECT doc_id AS id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, coalesce(lang, '(missing)') AS value, source FROM documents WHERE text IS NOT NULL)
SELECT value, count(*) AS records, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (source LIKE '%audit%') AS selected_records, CAST(coalesce(sum(tokens) FILTER (source LIKE '%audit%'), 0) AS BIGINT) AS selected_tokens,
round(sum(tokens) / (SELECT sum(tokens) FROM i), 4) AS share, round(coalesce(sum(tokens) FILTER (source LIKE '%audit%'), 0) / (SELECT sum(tokens) FROM i WHERE source LIKE '%audit%'), 4) AS selected_share FROM i GROUP BY 1""")
def selection_distribution(s, d):
    """Languages of all documents and of those from audit sources."""
    items = _items(s, d)
    return selection.distribution(items, items.where("source like '%audit%'"), "lang")


@query("""WITH i AS (SELECT doc_id AS id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CAST(length(text) AS DOUBLE) AS utility FROM documents WHERE text IS NOT NULL)
SELECT id, tokens, utility FROM (SELECT *, row_number() OVER (ORDER BY utility DESC, id) AS r FROM i) WHERE r <= (SELECT ceil(4.0 * 10000 / avg(tokens)) FROM i)""")
def shortlist(s, d):
    return selection.shortlist(_items(s, d), 10_000).select("id", "tokens", "utility")


_ALIGN = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
m AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY ALL) GROUP BY 1),
a AS (SELECT vec_id, m.label AS capability, list_cosine_similarity(e, c) AS score FROM v, m)"""


def _aligned(s: SparkSession, d: str) -> DataFrame:
    vectors = table(s, d, "embeddings")
    return selection.alignment(vectors.select("vec_id", "embedding"), "vec_id", "embedding", selection.mean_vectors(vectors, "label", "embedding"))


@query(f"WITH {_ALIGN} SELECT vec_id, capability, round(score, 5) AS score FROM a")
def alignment_scores(s, d):
    """Cosine of each vector with each label's mean vector."""
    return _aligned(s, d).select("vec_id", "capability", F.round("score", 5).alias("score"))


@query(f"WITH {_ALIGN} SELECT vec_id, round(max(score) FILTER (capability IN (0, 1)), 5) AS target, round(min(score) FILTER (capability IN (2, 3)), 5) AS retention FROM a GROUP BY 1")
def combined_scores(s, d):
    c = selection.combined(_aligned(s, d), "vec_id", [0, 1], [2, 3])
    return c.select("vec_id", F.round("target", 5).alias("target"), F.round("retention", 5).alias("retention"))


@query(f"WITH {_ALIGN}, c AS (SELECT vec_id, max(score) FILTER (capability IN (0, 1)) AS target FROM a GROUP BY 1) SELECT round(min(target), 5) AS least, round(quantile_cont(target, 0.5), 5) AS middle, round(max(target), 5) AS most, round(avg(target), 5) AS mean, count(*) FILTER (target < 0) AS negative FROM c")
def score_summary(s, d):
    out = selection.score_summary(selection.combined(_aligned(s, d), "vec_id", [0, 1], [2, 3]), "target")
    return out.select(*(F.round(c, 5).alias(c) for c in ("least", "middle", "most", "mean")), "negative")


@query(f"WITH {_ALIGN}, c AS (SELECT vec_id, max(score) FILTER (capability IN (0, 1)) AS target, min(score) FILTER (capability IN (2, 3)) AS retention FROM a GROUP BY 1) SELECT vec_id FROM c WHERE target > 0 AND retention >= -0.5")
def available_candidates(s, d):
    return selection.available(selection.combined(_aligned(s, d), "vec_id", [0, 1], [2, 3]), True, -0.5).select("vec_id")


@query()
def diverse_order(s, d):
    """The first 50 vectors by farthest-point order."""
    keys = selection.k_center(table(s, d, "embeddings"), "vec_id", "embedding", 50)
    return s.createDataFrame(list(enumerate(keys)), "place bigint, vec_id bigint")


@query()
def relevant_order(s, d):
    """The first 50 vectors by marginal relevance."""
    v = table(s, d, "embeddings").withColumn("u", F.get("embedding", F.lit(0)).cast("double"))
    keys = selection.marginal_relevance(v, "vec_id", "embedding", "u", 50)
    return s.createDataFrame(list(enumerate(keys)), "place bigint, vec_id bigint")


@query()
def sketched_vectors(s, d):
    out = selection.count_sketch(table(s, d, "embeddings"), "vec_id", "embedding", 16)
    return out.withColumn("value", F.round("value", 5))


_EVENTS = ["click", "error", "purchase", "signup", "view"]


@query("SELECT event_type AS stage, count(*) AS entries, round(sum(value), 4) AS cost, round(sum(value) / (SELECT sum(value) FROM events), 4) AS share FROM events GROUP BY 1 UNION ALL SELECT 'training', 0, 0.0, 0.0")
def ledger_summary(s, d):
    return stats.ledger(table(s, d, "events"), "event_type", "value", [*_EVENTS, "training"]).withColumn("cost", F.round("cost", 4))


_SPREAD = "p AS (SELECT event_type AS arm, user_id % 5 AS seed, avg(value) AS value FROM events GROUP BY ALL), r AS (SELECT arm, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS least, max(value) AS most FROM p GROUP BY 1)"


def _spread(s: SparkSession, d: str) -> DataFrame:
    values = table(s, d, "events").select(F.col("event_type").alias("arm"), (F.col("user_id") % 5).alias("seed"), "value")
    return stats.across_seeds(values, ["arm"], "seed", "value")


@query(f"WITH {_SPREAD} SELECT arm, n, round(mean, 6) AS mean, round(std, 6) AS std, round(least, 6) AS least, round(most, 6) AS most FROM r")
def across_seeds(s, d):
    return _spread(s, d).select("arm", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "least", "most")))


_T = "[" + ", ".join(map(str, stats.T95)) + "]"


@query(f"""WITH {_SPREAD}, w AS (SELECT a.arm, a.mean - b.mean AS difference, a.std * a.std / a.n AS va, b.std * b.std / b.n AS vb, a.n AS na, b.n AS nb FROM r a, r b WHERE b.arm = 'view' AND a.arm <> 'view'),
x AS (SELECT arm, difference, {_T}[CAST(floor((va + vb) * (va + vb) / (va * va / (na - 1) + vb * vb / (nb - 1))) AS INT)] * sqrt(va + vb) AS half FROM w)
SELECT arm, round(difference, 6) AS difference, round(difference - half, 6) AS low, round(difference + half, 6) AS high, CASE WHEN difference - half > 0 THEN 'supported' WHEN difference + half < 0 THEN 'contradicted' ELSE 'insufficient_evidence' END AS verdict FROM x""")
def welch_compare(s, d):
    out = stats.welch(_spread(s, d), "arm", "view")
    return out.select("arm", *(F.round(c, 6).alias(c) for c in ("difference", "low", "high")), "verdict")


@query()
def bootstrap_interval(s, d):
    return stats.bootstrap(table(s, d, "events"), "value", 200)


@query("WITH a AS (SELECT event_type AS arm, avg(value) AS m FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS arm, avg(value) AS m FROM events WHERE user_id % 2 = 1 GROUP BY 1) SELECT arm, round(a.m - b.m, 6) AS change, a.m - b.m >= -0.5 AS kept FROM a JOIN b USING (arm)")
def retention_gate(s, d):
    e = table(s, d, "events")
    half = lambda n: e.where(F.col("user_id") % 2 == n).groupBy(F.col("event_type").alias("arm")).agg(F.avg("value").alias("mean"))
    return stats.retention_gate(half(0), half(1), "arm", 0.5).withColumn("change", F.round("change", 6))


@query("SELECT arm, round(mean, 6) AS mean, budget FROM (SELECT event_type AS arm, avg(value) AS mean, CAST(count(*) AS DOUBLE) AS budget FROM events GROUP BY 1) WHERE mean > 0 ORDER BY mean DESC, budget, arm DESC LIMIT 1")
def best_candidate(s, d):
    arms = table(s, d, "events").groupBy(F.col("event_type").alias("arm")).agg(F.avg("value").alias("mean"), F.count("*").cast("double").alias("budget")).withColumn("kept", F.lit(True))
    return stats.best_candidate(arms, 1e12, 0.0).select("arm", F.round("mean", 6).alias("mean"), "budget")


@query("SELECT range AS step, round(CASE WHEN range < 10 THEN (range + 1) / 10.0 ELSE greatest(0, (100 - range) / 90.0) END, 9) AS rate FROM range(0, 100)")
def learning_rates(s, d):
    return s.range(100).select(F.col("id").alias("step"), F.round(stats.learning_rate(F.col("id"), 100, 0.1), 9).alias("rate"))


@query(sql.over_records("SELECT file, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * 9 AS DOUBLE) AS cost FROM tokens GROUP BY 1"))
def training_costs(s, d):
    t = rules.record_tokens(rec.all_records(s, d)).groupBy("file").agg(F.sum("tokens").alias("tokens"))
    return t.withColumn("cost", stats.training_cost(F.col("tokens"), 3))


@query(sql.over_records("SELECT DISTINCT f.file, f.line_no FROM finding f JOIN tokens t ON f.file = t.file AND f.line_no = t.line_no JOIN slot c ON c.file = f.file AND c.line_no = f.line_no WHERE starts_with(f.rule_id, 'dup') AND t.tokens > 100 AND contains(lower(c.content), 'ledger')"))
def row_query(s, d):
    """Duplicates over 100 tokens that mention a ledger."""
    records = rec.all_records(s, d)
    return reports.query_rows(records, _found(s, d), "rule:dup tokens>100 ledger")


@query(sql.over_records("SELECT file, line_no FROM rec WHERE NOT EXISTS (SELECT 1 FROM finding f WHERE f.file = rec.file AND f.line_no = rec.line_no)"))
def row_query_clean(s, d):
    """Lines of every table without a finding."""
    records = rec.all_records(s, d)
    return reports.query_rows(records, _found(s, d), "state:clean")


@query(f"SELECT line_no, CAST(len(list_filter(regexp_split_to_array(instruction, '[ ]+'), lambda w: w <> '')) AS BIGINT) AS words, {_P} = {_A} AS same FROM alpaca_clean WHERE instruction IS NOT NULL AND output IS NOT NULL")
def instruction_words(s, d):
    """Words of each instruction, and whether the answer is its copy."""
    rows = table(s, d, "alpaca_clean").where("instruction is not null and output is not null")
    count = F.size(F.filter(F.split("instruction", "[ ]+"), lambda w: w != ""))
    return rows.select("line_no", count.cast("bigint").alias("words"), (strip(F.col("instruction")) == strip(F.col("output"))).alias("same"))


_SAID = "list_filter(regexp_split_to_array({}, '[\\x{{9}}-\\x{{d}}\\x{{1c}}-\\x{{20}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda w: w <> '')"


@query(sql.over_records(
    """SELECT file, line_no, side, CAST(idx AS BIGINT) AS idx, round(shared / greatest(1, len(a)), 4) AS kept, round((len(b) - shared) / greatest(1, len(b)), 4) AS added FROM (
    SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))), 0) AS shared
    FROM (SELECT file, line_no, side, idx, """ + _SAID.format("content") + " AS a, " + _SAID.format("redacted") + " AS b FROM redacted))", sql.REDACTED))
def repair_overlap(s, d):
    """Share of words that redaction keeps, and of those it adds."""
    each = rec.slots(rec.all_records(s, d)).withColumn("after", pii.redacted(F.col("content"))).where("after <> content")
    return reports.word_overlap(each, "content", "after", ["file", "line_no", "side", "idx"])


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('rank:' || doc_id)) AS rank FROM documents")
def hashed_ranks(s, d):
    """Rank of each document in its language by hashed order."""
    rows = table(s, d, "documents").select("doc_id", "lang").withColumn("digest", ranking.seeded("rank", "doc_id"))
    return ranking.hashed_rank(rows, ["lang"], "digest").select("doc_id", "lang", "rank")
