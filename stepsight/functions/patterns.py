"""Patterns over shell commands and policy texts, in Java syntax: (?idU) makes \\w, \\s, \\b and $ agree with Unicode-aware engines."""

from __future__ import annotations

FLAGS = "(?idU)"
# Default tripwires by name, in the order in which they are tried.
TRIPWIRES = {
    "destructive-rm": r"\brm\s+(-\w*r\w*f\w*|-\w*f\w*r\w*)\b",
    "force-push": r"\bgit\s+push\b[^\n]*(--force\b|-f\b)",
    "db-migration": r"\b(alembic\s+upgrade|manage\.py\s+migrate|django-admin\s+migrate|rails\s+db:migrate|prisma\s+migrate\s+deploy)\b",
    "env-write": r"(^|[\s;&|])(>>?|\btee\b)[^\n]{0,40}\.env(\.[a-zA-Z0-9_]+)?(\s|$|['\"])",
    "docker-compose-down": r"\bdocker[\s-]compose\b[^\n]*\bdown\b",
    "kubectl-delete": r"\bkubectl\s+delete\b",
    "drop-table": r"\bDROP\s+TABLE\b",
}
# What counts as a verify command, and as a commit.
VERIFY = r"\b(?:pytest|unittest|jest|vitest|ruff|flake8|eslint|mypy|tox)\b|\bnpm\s+(?:test|run\s+test)\b|\bgo\s+test\b|\bcargo\s+test\b|\bmake\s+(?:test|lint)\b"
COMMIT = r"\bgit\s+commit\b"
# Concepts of a policy text.
CONCEPTS = {
    "delete / rm -rf": r"\bdelete\b|\brm\s+(-\w*r\w*f\w*|-\w*f\w*r\w*)\b",
    "run tests / lint before commit": r"before\s+(every|each)\s+commit|run\s+tests|linter\s+before",
    ".env / secret / credential": r"\.env\b|\bsecrets?\b|\bcredentials?\b",
    "database migration": r"\bmigrations?\b|\bmigrate\b",
    "docker compose": r"\bdocker[\s-]compose\b",
    "infrastructure / deploy config": r"\binfrastructure\b|\binfra/|\bdeploy(?:ment)?\b",
    "kubectl / kubernetes": r"\bkubectl\b|\bkubernetes\b",
}
# Tools by what they do.
EDITORS = ("Write", "Edit", "NotebookEdit")
EDITS = ("Edit", "NotebookEdit")
DELEGATES = ("Task", "Agent")
