"""Readers, declared layers and sinks."""
