"""Readers, writers and the tables the operators work on."""
