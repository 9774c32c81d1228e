"""Readers and writers of events, frames, archives, telemetry and statistics."""
