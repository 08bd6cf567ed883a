"""Sinks: drafts of notes, their writer, and reports of a run."""
