"""Pieces of SQL that several oracle statements share."""

from __future__ import annotations

from gradeloom.functions.vector import NUMBER


def items(col: str) -> str:
    return f"list_filter(list_transform(string_split({col}, ','), lambda x: trim(x, ' ')), lambda x: x <> '')"


def hist(col: str) -> str:
    """A text histogram as DOUBLE[64], or NULL if it isn't sound."""
    i = items(col)
    return f"CASE WHEN len({i}) = 64 AND list_bool_and(list_transform({i}, lambda x: regexp_matches(x, '{NUMBER}'))) THEN list_transform({i}, lambda x: x::DOUBLE) END"


def measured_sql(col: str) -> str:
    """A measurement that is NaN is none. It is told by its text, as isnan is folded by the statistics of a Parquet file, which leave NaN out."""
    return f"CASE WHEN {col}::VARCHAR = 'nan' THEN NULL ELSE {col} END"


TAGS = """tg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn_ FROM tags WHERE trim(tag, ' ') <> '') WHERE rn_ = 1)"""
SESSIONS = """ses AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, ingested_at DESC) AS rn_ FROM analytics_sessions) WHERE rn_ = 1)"""
INFO = """inf AS (SELECT fp.*, f.filename, f.format, f.transfer, f.width, f.height, f.project_id, p.name AS project_name, p.path FROM fingerprints fp
  JOIN files f ON f.id = fp.file_id JOIN projects p ON p.id = f.project_id)"""
HISTS = f"""hi AS (SELECT * FROM (SELECT id, file_id, {hist('histogram_r')} AS hist_r, {hist('histogram_g')} AS hist_g, {hist('histogram_b')} AS hist_b FROM fingerprints)
  WHERE hist_r IS NOT NULL AND hist_g IS NOT NULL AND hist_b IS NOT NULL)"""
FEEDBACK = """fb AS (SELECT DISTINCT result_id AS id, project_name, file_path, file_format, CASE WHEN score >= 0.8 THEN 'accepted' ELSE 'rejected' END AS action, search_type,
  floor(epoch_us(logged_at) / 1000000)::BIGINT AS created_at FROM search_results WHERE project_name IS NOT NULL AND file_path IS NOT NULL AND score IS NOT NULL AND NOT isnan(score))"""
CALIBRATIONS = """cal AS (SELECT entry_id AS id, split_part(image_path, '/', 4) AS project_name, coalesce(grading_style_tags, []) AS added, created_at FROM dataset_entries)"""
LUTS = """lt AS (SELECT id, project_id, id AS fingerprint_id, 'grade ' || id AS title, ['cube', '3dl', 'look', 'csp'][id % 4 + 1] AS format,
  CASE WHEN id % 20 = 0 THEN 33 ELSE 17 END::BIGINT AS grid_size, '/luts/' || (id % 50) || '.' || ['cube', '3dl', 'look', 'csp'][id % 4 + 1] AS output_path, created_at FROM inf)"""
MESSAGES = """msg AS (SELECT session_id, seq, regexp_extract(line, '^(user|assistant|system): ', 1) AS role, regexp_replace(line, '^(user|assistant|system): ', '') AS content FROM
  (SELECT doc_id AS session_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents WHERE source = 'agent_chat' AND text IS NOT NULL)
  WHERE regexp_matches(line, '^(user|assistant|system): '))"""
ADDED = "(SELECT id, project_name, created_at, unnest(added) AS tag FROM cal)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
