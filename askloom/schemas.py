"""Declared schemas of the relational tables and evaluation sets."""

from __future__ import annotations

TABLES = {
    "users": (
        "id bigint, username string, email string, hashed_password string, role string,"
        " is_active boolean, pending_approval boolean, approval_status string,"
        " ban_until timestamp_ntz, can_modify_profile boolean, max_questions_per_day int,"
        " max_uploads_per_day int, questions_today int, uploads_today int, last_reset_date date,"
        " current_session_id string, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "chat_sessions": (
        "id bigint, user_id bigint, title string, created_at timestamp_ntz,"
        " updated_at timestamp_ntz"
    ),
    "messages": (
        "id bigint, session_id bigint, role string, content string, sources string,"
        " confidence string, features string, token_usage string, feedback string,"
        " created_at timestamp_ntz"
    ),
    "documents": (
        "id bigint, filename string, file_path string, file_size bigint, category string,"
        " description string, status string, review_status string, split_group_id string,"
        " reviewed_by bigint, reviewed_at timestamp_ntz, reject_reason string,"
        " uploaded_by bigint, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "parent_chunks": (
        "id bigint, document_id bigint, parent_id string, parent_content string,"
        " split_group_id string, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "document_children": (
        "id string, document_id bigint, parent_id string, child_id string, child_content string,"
        " split_group_id string, embedding array<float>"
    ),
    "question_stats": (
        "id bigint, content string, count bigint, created_at timestamp_ntz,"
        " updated_at timestamp_ntz"
    ),
    "login_records": (
        "id bigint, user_id bigint, username string, login_time timestamp_ntz,"
        " ip_address string, user_agent string, success boolean, failure_reason string"
    ),
    "announcements": (
        "id bigint, title string, content string, is_active boolean, is_popup boolean,"
        " show_once boolean, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "system_settings": (
        "id bigint, setting_key string, setting_value string, description string,"
        " created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "model_configs": (
        "id bigint, model_type string, model_name string, api_key string, api_base_url string,"
        " dimension int, is_active boolean, is_default boolean, config map<string,string>,"
        " created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
}

GOLDEN = (
    "question string, expected_keywords array<string>, expected_content array<string>,"
    " source_section string, difficulty string, category string"
)

# One fixed schema for retrieval hits; score columns a stage has not filled yet are absent.
HIT_KEY = ["query_id", "document_id", "parent_id"]
