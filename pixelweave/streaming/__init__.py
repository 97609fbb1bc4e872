"""Change detection on streams of scenes."""
