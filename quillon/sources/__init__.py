"""Readers, sinks and adapter views."""
