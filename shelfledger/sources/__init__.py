"""Readers, writers and the views that map a star schema onto the retail model."""
