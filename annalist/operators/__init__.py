"""Operators over the canonical tables: telemetry, catalog, retrieval, backlog, adoption, evaluation."""
