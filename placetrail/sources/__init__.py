"""Readers and writers: tables, text logs, reports and the snapshot store."""
