"""Composed audit plans: features, model, weather, findings, ingest, review, reports."""
