"""Outputs of the triage engine."""
