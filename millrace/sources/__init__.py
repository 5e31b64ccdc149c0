"""Codecs, files and directories."""
