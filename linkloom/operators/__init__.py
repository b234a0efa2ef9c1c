"""Relational operators over scrapes and stories."""
