"""Table schemas of the store; nothing is inferred."""

COMMITS = "commit_id string, repo string, branch string, parent_id string, depth int, created_at timestamp, description string, started boolean, finished boolean, empty boolean, provenance array<string>"
FILE_OPS = "repo string, commit_id string, op_idx int, path string, kind string, sha string, size bigint, content string"
FILES = "array<struct<path:string,hash:string,size:bigint>>"
JOBS = "job_id string, pipeline string, version int, state string, reason string, input_commits array<string>, output_commit string, started timestamp, finished timestamp, processed int, recovered int, failed int, skipped int"
DEDUP = "pipeline string, datum_id string, hash string, outcome string, transform_hash string, path string, content string"
LOGS = "job_id string, pos bigint, t timestamp, line string"
TAGS = "name string, seq bigint, ref string"
