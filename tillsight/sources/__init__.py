"""Readers: ticket lines, CSV exports, JSON landings, snapshots."""
