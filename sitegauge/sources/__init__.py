"""Readers of stored API answers, pages, lexicons and configuration."""
