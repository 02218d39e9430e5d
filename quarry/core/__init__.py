"""Shared building blocks: tables, checkpoints, components, sampling, set similarity."""
