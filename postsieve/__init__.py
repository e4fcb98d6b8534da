"""Posting digests on Spark: scan pages, extract fields, score, filter, dedupe, write."""

from .session import build_session, scratch_path, settled_table, use_checkpoint_dir

__all__ = ["build_session", "scratch_path", "settled_table", "use_checkpoint_dir"]
