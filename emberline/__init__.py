"""emberline: activation analytics on post and news archives, as Spark DataFrame jobs."""

from emberline.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
