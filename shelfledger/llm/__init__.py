"""Preparation of text corpora for training; nothing else in the library imports it."""
