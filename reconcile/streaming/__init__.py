"""Structured Streaming versions of the change signal and the audit tail.

Order comes from a monotonic version, so maxima are idempotent under replay
and late arrival; no watermark is needed and state grows with keys only.
"""
