"""Readers, writers and schema discovery."""
