"""Structured Streaming forms of the scan, the audit log and access sessions."""
