"""The textual pipeline language: tokens, expressions, scripts."""
