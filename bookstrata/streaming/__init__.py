"""Structured Streaming forms of the live path; each equals its batch operator on the same rows."""
