"""Table schemas and the small closed vocabularies used across operators."""

# Closed vocabularies.
CATEGORIES = (
    "security", "bug", "architecture", "performance",
    "business_logic", "test", "code_quality", "style",
)
PRIORITIES = ("critical", "high", "medium", "low", "info")
FEEDBACK_TYPES = ("positive", "negative", "neutral", "correction", "ignored")
FEEDBACK_SOURCES = ("github_reaction", "comment_reply", "manual", "auto_detected")

def _ddl(text: str) -> str:
    return " ".join(text.split())


# DDL strings work everywhere Spark takes a schema and need no live session.
PRS = _ddl(
    """pr_id string, pr_number bigint, title string, description string,
    repo_owner string, repo_name string, base_branch string, head_branch string,
    author string, state string, labels array<string>,
    created_at timestamp, updated_at timestamp"""
)
FILE_DIFFS = _ddl(
    """pr_id string, file_ord int, file_path string, additions int, deletions int,
    changes int, diff string, status string, language string"""
)
COMMIT_FILES = _ddl(
    """pr_id string, commit_ord int, sha string, message string, author string,
    ts timestamp, filename string, additions int, deletions int"""
)
ISSUES = _ddl(
    """issue_id string, repo_owner string, repo_name string, title string, body string,
    labels array<string>, state string, created_at timestamp, closed_at timestamp"""
)
REPOS = _ddl(
    """owner string, name string, full_name string, default_branch string,
    language string, languages map<string,bigint>"""
)
FEEDBACK = _ddl(
    """id string, analysis_result_id string, pr_id string, pr_number bigint,
    repo_owner string, repo_name string, feedback_type string, source string,
    reviewer string, comment string, correction string, category string,
    file_path string, line_number int, metadata map<string,string>, ts timestamp"""
)
LEARNING_PATTERNS = _ddl(
    """pattern_id string, pattern_type string, category string,
    pattern_description string, file_pattern string, code_pattern string,
    feedback_count bigint, confidence_multiplier double, conf_min double,
    conf_max double, should_apply boolean"""
)
TEAM_CONTEXT = _ddl(
    """team_name string,
    coding_conventions struct<naming:struct<functions:string,classes:string,constants:string>,
    max_line_length:int,docstring_style:string>,
    known_patterns array<string>, anti_patterns array<string>,
    recent_refactors array<string>, team_members array<string>"""
)
RULES = _ddl(
    """name string, pattern string, category string, priority string,
    confidence double, message string, suggestion string"""
)
WEBHOOK_PAYLOAD = _ddl(
    """action string, pull_request struct<number:bigint>,
    repository struct<name:string,owner:struct<login:string,name:string>>,
    comment struct<body:string,user:struct<login:string>>,
    issue struct<number:bigint,html_url:string>"""
)
# Findings as they travel through ranking: constants of a rule are attached later.
SLIM_FINDING_COLUMNS = (
    "pr_id", "file_path", "line_start", "rule_no", "confidence",
    "arg", "code_snippet", "file_ord", "match_ord",
)
