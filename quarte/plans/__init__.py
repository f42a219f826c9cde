"""Registered queries, grouped like the operators they run."""

from importlib import import_module

GROUPS = (
    "projections", "windows", "decisions", "logs", "matches", "repairs", "evaluation", "tracked", "whole_jobs",
    "streams", "framing", "models", "sinks",
)


def load() -> None:
    for group in GROUPS:
        import_module(f"quarte.plans.{group}")
