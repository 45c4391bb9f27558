"""Fixed values that results depend on.

FIXED VALUES — these strings, keyword lists, checklists and templates must
equal the behaviour being reproduced; they are listed here plainly and in
their natural order so every operator uses the same copy.
"""

# ---- FIXED VALUES: work-item types, states, defaults -----------------------
WORK_ITEM_TYPES = ["Product Backlog Item", "Bug", "User Story"]
DEFAULT_ITEM_TYPE = "User Story"
DEFAULT_PRIORITY = 9999
DEFAULT_STATE = "Active"
CLOSED_STATE = "Closed"
REPO_TAG_PREFIX = "repo:"
DEFAULT_REPO = "data-engineering-repo"
BRANCH_PREFIX = "feature/pbi-"

# ---- FIXED VALUES: plan extraction ------------------------------------------
JDBC_TERMS = ["jdbc", "edw"]
FLAT_FILE_TERMS = ["flat file", "volume", "csv"]
DEFAULT_CATALOG = "main"
DEFAULT_SCHEMA = "bronze"
TARGET_LAYER = "bronze"
TABLE_PATTERN = r"([a-zA-Z0-9_]+)\.([a-zA-Z0-9_]+)\.([a-zA-Z0-9_]+)"
NOTEBOOK_TASKS = ["create_unity_catalog_table", "run_ingestion_notebook", "run_data_quality_checks"]
RISK_JDBC = "Validate JDBC credentials and source-side throttling."
RISK_OVERWRITE = "Ensure overwrite strategy is approved for target table."
Q_TABLE = "Please provide the exact Unity Catalog target table as <catalog>.<schema>.<table>."
Q_SOURCE = "What is the ingestion source type (jdbc/flat file/volume/other) and connection details?"
Q_MODE = "Should ingestion mode be append or overwrite?"
Q_REPO = "Which repository should be used? If new, provide repository name and confirm creation."
Q_CRITERIA = "Please provide acceptance criteria and data quality expectations."
AUTO_ANSWER = "auto-default"

# ---- FIXED VALUES: stages, promotion, approvals -----------------------------
STAGE_SEQUENCE = ["dev", "qe", "stg", "prod"]
APPLY_STAGES = ["dev"]
APPROVAL_STAGES = ["qe", "stg", "prod"]
AUTO_APPROVE_STAGES = ["dev"]
PROMOTABLE_STATUSES = ["succeeded", "success", "completed"]
NON_TERMINAL_STATUSES = ["inprogress", "notstarted"]
MAX_REMEDIATION_ATTEMPTS = 2
PIPELINE_PREFIX = "local"
STAGE_CHECKLISTS = {
    "qe": [
        "Validate schema compatibility and data quality checks.",
        "Confirm unit and integration tests passed in pipeline artifacts.",
        "Review rollback plan and deployment notes.",
    ],
    "stg": [
        "Review performance and scalability metrics.",
        "Confirm RFC/CAB prerequisites are complete.",
        "Validate production-like data contract behavior.",
    ],
    "prod": [
        "Confirm final change window approval.",
        "Validate monitoring alerts and on-call readiness.",
        "Verify backup and rollback controls.",
    ],
}
DEFAULT_CHECKLIST = ["Review stage deployment evidence before approving."]
HIGH_RISK_STAGES = ["prod"]
RECOMMENDED_ACTION = "approve_if_all_checks_pass"

# ---- FIXED VALUES: QA check names per stage ---------------------------------
QA_CHECKS = {
    "dev": ["table_exists", "row_count_non_zero", "schema_validation", "dq_rules_passed"],
    "qe": ["smoke_test_query_success", "schema_validation", "dq_rules_passed", "row_delta_within_threshold"],
    "stg": ["regression_suite_passed", "performance_baseline_passed", "schema_drift_absent"],
    "prod": ["post_deploy_smoke_passed", "critical_dq_rules_passed", "monitoring_alerts_green"],
}
QA_DEFAULT_CHECKS = ["table_exists", "dq_rules_passed"]

# ---- FIXED VALUES: remediation plugins --------------------------------------
PLUGIN_ORDER = ["databricks_notebook", "sql", "python_etl"]
NOTEBOOK_HINTS = ["analysisexception", "schema mismatch", "delta", "databricks", "notebook"]
SQL_HINTS = ["table", "view", "schema", "catalog", "not found", "does not exist"]
ETL_HINTS = ["schema mismatch", "analysisexception", "cannot resolve", "column", "delta"]
NOTEBOOK_CONF_LINE = 'spark.conf.set("spark.databricks.delta.schema.autoMerge.enabled", "true")'
NOTEBOOK_BOOTSTRAP = [
    "try:",
    "    spark",
    "except NameError:",
    "    from pyspark.sql import SparkSession",
    "    spark = SparkSession.builder.getOrCreate()",
]
NOTEBOOK_MARKER = "# Added by remediation plugin for Delta schema evolution compatibility."
SQL_MARKER = "-- Added by remediation plugin to prevent missing namespace failures."
ETL_EXCLUDED_PARTS = ["tests", "generated_changes", "transformers"]
ETL_INCLUDED_PARTS = ["etl", "pipelines", "jobs", "notebooks"]
NO_PLUGIN_TEXT = "no transformer plugin changed repository files"
PLUGIN_SUMMARIES = {
    "databricks_notebook": "Enabled Delta auto-merge in Databricks notebook code paths.",
    "sql": "Added SQL bootstrap statements for catalog/schema existence.",
    "python_etl": "Added mergeSchema write option to Python ETL Delta writes.",
}

# ---- FIXED VALUES: network ---------------------------------------------------
INTERNAL_HOST_SUFFIXES = ["localhost", "127.0.0.1", ".local", ".internal", ".corp", ".intranet"]
ALLOWED_EGRESS_SUFFIXES = [
    "dev.azure.com", ".azuredatabricks.net", "localhost", "127.0.0.1",
    ".local", ".internal", ".corp", ".intranet",
]
READINESS_CHECKS = ["azure_devops", "azure_repos", "azure_pipelines", "databricks", "llm", "mcp", "security"]

# ---- FIXED VALUES: payload bounds -------------------------------------------
ACTOR_MIN_LEN = 2
ACTOR_MAX_LEN = 128
COMMENT_MAX_LEN = 500
MESSAGE_MIN_LEN = 1
MESSAGE_MAX_LEN = 4000

# ---- FIXED VALUES: prompt templates -----------------------------------------
TEMPLATES = {
    "requirement_summary": (
        "You are processing a data engineering work item for an Azure-first platform.\n"
        "Title: {title}\n"
        "Description: {description}\n"
        "Acceptance Criteria: {acceptance_criteria}\n"
        "Priority: {priority}\n"
        "Target Repo: {target_repo}\n"
        "MCP Status: {mcp_status}\n"
        "\n"
        "Generate a concise execution summary that covers repository impact, ingestion intent,\n"
        "and release-safety expectations for human-in-the-loop approvals.\n"
    ),
    "approval_suggestion": (
        "You are assisting a human approver for deployment stage {stage}.\n"
        "Stage risk: {risk_level}\n"
        "Deployment summary: {summary}\n"
        "Required checklist: {checklist}\n"
        "\n"
        "Provide a concise recommendation:\n"
        "- whether to approve or hold\n"
        "- top 2 risks\n"
        "- top 2 validation steps\n"
    ),
    "failure_remediation": (
        "You are diagnosing a CI/CD pipeline failure for a data engineering deployment.\n"
        "Environment: {environment}\n"
        "Attempt: {attempt}\n"
        "Target table: {target_table}\n"
        "Repo: {repo}\n"
        "Ingestion mode: {ingestion_mode}\n"
        "Failure context:\n"
        "{failure_context}\n"
        "\n"
        "Return concise remediation guidance:\n"
        "- probable root cause\n"
        "- exact files/notebooks likely impacted\n"
        "- minimal safe fix steps\n"
        "- smoke tests to run after fix\n"
    ),
    "hil_chat_response": (
        "You are the assistant in an enterprise Human-in-Loop operations console for agentic data engineering delivery.\n"
        "Human message: {message}\n"
        "Context: {context}\n"
        "Pending approvals: {pending_approvals}\n"
        "Pending clarifications: {pending_clarifications}\n"
        "Active work items: {active_items}\n"
        "\n"
        "Provide a concise, actionable response with:\n"
        "- immediate next action\n"
        "- any needed HIL decision\n"
        "- risk note if relevant\n"
    ),
}
