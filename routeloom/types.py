"""Row schemas of the catalogue (Spark DDL)."""

PAIR = (
    "seq BIGINT, observed_at TIMESTAMP, method STRING, raw_path STRING, req_content_type STRING, resp_content_type STRING, "
    "status_code INT, latency_ms BIGINT, req_body BINARY, resp_body BINARY, req_headers ARRAY<STRING>"
)
FIELDS = "ARRAY<STRUCT<field_path: STRING, type_json: STRING>>"
OBSERVATION = (
    "seq BIGINT, observed_at TIMESTAMP, method STRING, path_pattern STRING, raw_path STRING, protocol STRING, status_code INT, latency_ms BIGINT, "
    "req_content_type STRING, resp_content_type STRING, req_schema STRING, resp_schema STRING, "
    f"req_fields {FIELDS}, resp_fields {FIELDS}, header_names ARRAY<STRING>, param_names ARRAY<STRING>, fingerprint STRING"
)
ENDPOINT = (
    "method STRING, path_pattern STRING, protocol STRING, source STRING, framework STRING, source_file STRING, source_line INT, "
    "first_seen TIMESTAMP, last_seen TIMESTAMP, call_count BIGINT, description STRING, tags ARRAY<STRING>, deprecated BOOLEAN, requires_auth BOOLEAN"
)
FIELD = "method STRING, path_pattern STRING, location STRING, field_path STRING, seen_count BIGINT, total_calls BIGINT, type_json STRING"
SCANNED = (
    "method STRING, path_pattern STRING, protocol STRING, framework STRING, source_file STRING, source_line INT, req_schema STRING, resp_schema STRING, "
    "status_codes ARRAY<INT>, description STRING, tags ARRAY<STRING>, params ARRAY<STRUCT<name: STRING, `in`: STRING, required: BOOLEAN, schema: STRING>>, "
    "deprecated BOOLEAN, requires_auth BOOLEAN"
)
SOURCE_FILE = "path STRING, content STRING"
