"""Posting analytics on Spark: normalise, dedup, gate, score, track and publish."""

from postsieve.policy import Policy, load_policy

__all__ = ["Policy", "load_policy"]
