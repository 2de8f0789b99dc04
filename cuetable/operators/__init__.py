"""Operators over the caption, clip, marker and review relations."""
