"""Whole methods, each one lazy query where no model is trained."""
