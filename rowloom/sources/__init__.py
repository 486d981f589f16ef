"""Scans, archive expansion, table and report files, markup flattening."""
